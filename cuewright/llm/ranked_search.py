"""Ranked lexical search over a length-stratified index.

Documents of one normaliser ``m`` (their length against the mean) are a stratum.  An index row is a shelf: up to ``SHELF_DOCS``
neighbouring documents in order of m, so a stratum of any share is spread over many shelves and a shelf may
hold several small strata.  Within a stratum the postings of a term are grouped by tf, since documents of one
m and one tf have one impact: it is worked out once for the group and holds for all its documents.

A stratum's bound for an item is the sum of its terms' weights times their impacts at the greatest tf there.  A first
visit scores, for each item, the strata of highest bounds until they hold enough documents; the k-th best score
is a floor for that item.  Then all shelves are visited, those of an Arrow batch in order of their bounds, the floor rising in each
task with what it finds, and a stratum whose bound is below an item's floor is passed over.  Bounds and floors never drop
a document that belongs among the first k, ties included.

Items come in blocks of about ``ITEM_BLOCK``, joined to the shelves by block: broadcast while the
blocks' saved files are small, else dealt over ``SALTS`` copies.  Scores are 64-bit integers throughout.

Defined results: null and empty texts have no terms and no rank; a document that repeats another's id is a document of
its own; equal scores go by ascending ``doc_id`` (null last); items that repeat an id are one item of all their terms; a null
item id is an item; items without a known term have no rows; a text of any length counts whole; an empty table
of either kind gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, small_side
from .textkit import release

#: A term: a maximal run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the score: parts of a thousand, of m for the mean length, and of the impact.
WEIGHT_SCALE, LENGTH_BASE, LENGTH_PART, IMPACT_SCALE, TF_SCALE, M_SCALE = 1000, 100, 50, 1_000_000_000, 1000, 20
#: Documents and about most postings of a shelf.
SHELF_DOCS, SHELF_POSTINGS = 2048, 400_000
#: Items that are searched together, and copies of a block of them where it is not broadcast.
ITEM_BLOCK, SALTS = 256, 64
#: A first visit scores at least so many times k documents for each item.
FIRST_VISIT = 4

POSTING = "row long, doc_id long, n long, term string, tf long"
SHELF = "shelf long, docs array<long>, m array<long>, upto array<int>, stratum array<int>, term array<int>, tf array<long>, size array<int>, places array<int>"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def postings(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, term, tf) of each document's terms; ``row`` tells documents apart whatever their ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])
        try:
            for batch in batches:
                terms, tfs, size, length = [], [], [], []
                for text in batch.column("text").to_pylist():
                    found = Counter(find(text.translate(_LOWER)))
                    terms += found
                    tfs += found.values()
                    size.append(len(found))
                    length.append(found.total())
                each = np.repeat(np.arange(len(size)), size)
                columns = [batch.column("row").take(pa.array(each)), batch.column("doc_id").take(pa.array(each)), pa.array(np.array(length, dtype=np.int64)[each]), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, schema=schema)
                for lo in range(0, len(each), 1 << 16):
                    yield whole.slice(lo, 1 << 16)
        finally:
            release()

    numbered = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(count, POSTING)


def shelves(placed: DataFrame) -> DataFrame:
    """Index rows from (m, row, doc_id, term, tf) with terms as numbers, sorted by (m, row) in each partition."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shelf", pa.int64()), ("docs", pa.list_(pa.int64())), ("m", pa.list_(pa.int64())), ("upto", pa.list_(pa.int32())), ("stratum", pa.list_(pa.int32())), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])
        waiting: list[pa.RecordBatch] = []

        def shelf(rows: pa.Table) -> pa.RecordBatch:
            m, row, term, tf = (rows.column(c).to_numpy() for c in ("m", "row", "term", "tf"))
            new = np.flatnonzero(np.diff(row, prepend=-1) != 0)
            place = np.cumsum(np.diff(row, prepend=-1) != 0) - 1
            ms, start = np.unique(m[new], return_index=True)
            stratum = np.searchsorted(ms, m)
            order = np.lexsort((place, tf, term, stratum))
            s, t, f = stratum[order], term[order], tf[order]
            first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1]) | (f[1:] != f[:-1])]))
            size = np.diff(np.append(first, len(s)))
            docs = rows.column("doc_id").combine_chunks().take(pa.array(new)).to_pylist()
            values = [int(row[0]), docs, ms, np.append(start[1:], len(new)), s[first], t[first], f[first], size, place[order]]
            return pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, (int, list)) else v.tolist()], k.type) for v, k in zip(values, schema, strict=True)], schema=schema)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Full shelves of what waits; a document is never cut."""
            nonlocal waiting
            rows = pa.Table.from_batches(waiting)
            new = np.flatnonzero(np.diff(rows.column("row").to_numpy(), prepend=-1) != 0)
            lo = 0
            while lo < len(new):
                hi = min(lo + SHELF_DOCS, max(lo + 1, int(np.searchsorted(new, new[lo] + SHELF_POSTINGS, side="right")) - 1))
                if hi >= len(new):
                    if not last:
                        break
                    hi = len(new)
                end = new[hi] if hi < len(new) else len(rows)
                yield shelf(rows.slice(new[lo], end - new[lo]))
                lo = hi
            waiting = rows.slice(new[lo]).combine_chunks().to_batches() if lo < len(new) else []

        try:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    if sum(b.num_rows for b in waiting) >= 2 * SHELF_POSTINGS:
                        yield from cut(False)
            if waiting:
                yield from cut(True)
        finally:
            release()

    return placed.mapInArrow(fill, SHELF)


class Shelf:
    """An index row, with the impact of each (stratum, term, tf), worked out once."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda c: batch.column(c)[i].values
        self.docs = get("docs")
        self.stratum, self.term, self.size, self.upto = (get(c).to_numpy().astype(np.int64) for c in ("stratum", "term", "size", "upto"))
        self.places = get("places").to_numpy()
        self.m, tf = get("m").to_numpy(), get("tf").to_numpy()
        self.impact = (IMPACT_SCALE * tf) // (TF_SCALE * tf + M_SCALE * self.m[self.stratum])
        #: The greatest tf of a term in a stratum comes last.
        self.last = np.append((self.term[1:] != self.term[:-1]) | (self.stratum[1:] != self.stratum[:-1]), True)


class Items:
    """A block of items: for each term the items that have it, with weights; and each item's floor."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda c: batch.column(c)[i].values.to_numpy()
        self.items, at = np.unique(get("item"), return_inverse=True)
        order = np.argsort(get("of"), kind="stable")
        self.terms, first = np.unique(get("of")[order], return_index=True)
        self.first = np.append(first, len(order))
        self.at, self.weight = at[order], get("weight")[order]
        self.floor = np.zeros(len(self.items), dtype=np.int64)
        np.maximum.at(self.floor, at, get("floor"))

    def met(self, shelf: Shelf, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the given groups of a shelf: group, item and weight of each pair that has a term in common."""
        k = np.minimum(np.searchsorted(self.terms, shelf.term[which]), len(self.terms) - 1)
        hit = self.terms[k] == shelf.term[which]
        which, k = which[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(self.first[k], n) + inside
        return np.repeat(which, n), self.at[pair], self.weight[pair]

    def bounds(self, shelf: Shelf) -> np.ndarray:
        """For each stratum and item, a score that no document of the stratum exceeds."""
        out = np.zeros((len(shelf.m), len(self.items)), dtype=np.int64)
        group, item, weight = self.met(shelf, np.flatnonzero(shelf.last))
        np.add.at(out, (shelf.stratum[group], item), weight * shelf.impact[group])
        return out


class Best:
    """The k best (score, document) of each item of a block so far, and the floors they give."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def visit(self, shelf: Shelf, wanted: np.ndarray) -> None:
        """Score the strata of a shelf for the items that want them."""
        group, item, weight = self.items.met(shelf, np.arange(len(shelf.term)))
        keep = wanted[shelf.stratum[group], item]
        group, item, weight = group[keep], item[keep], weight[keep]
        n = shelf.size[group]
        start = np.cumsum(shelf.size) - shelf.size
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = shelf.places[np.repeat(start[group], n) + inside]
        total = np.zeros((len(self.items.items), len(shelf.docs)), dtype=np.int64)
        np.add.at(total, (np.repeat(item, n), place), np.repeat(weight * shelf.impact[group], n))
        i, p = np.nonzero((total >= self.items.floor[:, None]) & (total > 0))
        doc = shelf.docs.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.item, self.score, self.doc = (np.concatenate(x) for x in ((self.item, i), (self.score, total[i, p]), (self.doc, doc[p])))
        order = np.lexsort((self.doc, -self.score, self.item))
        first = np.searchsorted(self.item[order], self.item[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.item, self.score, self.doc = self.item[order], self.score[order], self.doc[order]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.items.items)) >= self.k)
        least = np.searchsorted(self.item, full, side="right") - 1
        self.items.floor[full] = np.maximum(self.items.floor[full], self.score[least])

    def rows(self) -> pa.RecordBatch:
        none = self.doc == np.iinfo(np.int64).max
        return pa.RecordBatch.from_arrays([pa.array(self.items.items[self.item]), pa.array(self.doc, mask=none), pa.array(self.score)], names=["item", "doc_id", "score"])


def first_strata(shelves_and_items: DataFrame, enough: int) -> DataFrame:
    """(item, shelf, stratum, docs, bound): in each batch, an item's strata of highest bounds, until they hold enough documents."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                shelf, items = Shelf(batch, i), Items(batch, i)
                bound = items.bounds(shelf)
                held = np.diff(shelf.upto, prepend=0)
                for j in range(bound.shape[1]):
                    order = np.argsort(-bound[:, j], kind="stable")
                    order = order[: int(np.searchsorted(np.cumsum(held[order]), enough)) + 1]
                    order = order[bound[order, j] > 0]
                    out.append((np.full(len(order), items.items[j]), np.full(len(order), batch.column("shelf")[i].as_py()), order, held[order], bound[order, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["item", "shelf", "stratum", "docs", "bound"])

    found = shelves_and_items.mapInArrow(look, "item long, shelf long, stratum long, docs long, bound long")
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "shelf", "stratum")
    before = F.coalesce(F.sum("docs").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).where(F.col("before") < enough).select("item", "shelf", "stratum")


def scored(shelves_and_items: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): what may be among the k best of each item; with a column ``strata`` only those strata are visited."""
    chosen = "strata" in shelves_and_items.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        try:
            for batch in batches:
                due = []
                for i in range(batch.num_rows):
                    block = batch.column("block")[i].as_py()
                    if block not in best:
                        best[block] = Best(Items(batch, i), k)
                    mine = best[block]
                    shelf = Shelf(batch, i)
                    bound = mine.items.bounds(shelf)
                    if chosen:
                        only = np.array([(x["stratum"], x["item"]) for x in batch.column("strata")[i].as_py()])
                        wanted = np.zeros(bound.shape, dtype=bool)
                        wanted[only[:, 0], np.searchsorted(mine.items.items, only[:, 1])] = True
                        bound[~wanted] = 0
                    due.append((-int(bound.max(initial=0)), i, mine, shelf, bound))
                for _, _, mine, shelf, bound in sorted(due, key=lambda x: x[:2]):
                    wanted = (bound >= mine.items.floor) & (bound > 0)
                    if wanted.any():
                        mine.visit(shelf, wanted)
            for b in best.values():
                yield b.rows()
        finally:
            release()

    return shelves_and_items.mapInArrow(search, "item long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text)."""
    texts = items.groupBy("item_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).orderBy("item_id")
    named = scratch.save(texts.select("item_id", "text", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("item")))
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), F.lit(TERM), F.lit(0)))
    wanted = scratch.save(named.select("item", F.explode(words).alias("term")))
    known = wanted.select("term").distinct()
    known = scratch.save(known.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("of")))

    all_terms = scratch.save(postings(docs))
    each = all_terms.groupBy("row").agg(F.first("n").alias("n"))
    count, total = each.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return named.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    used = scratch.save(all_terms.join(small_side(scratch, known), "term").select("row", "doc_id", "n", "of", "tf"))
    df = used.groupBy("of").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT_SCALE)) * F.log(F.lit(float(2 * count + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = wanted.join(known, "term").join(df, "of").select("item", "of", weight.alias("weight"))

    m = F.lit(LENGTH_BASE - LENGTH_PART) + F.expr(f"(n * {LENGTH_PART * count}L) div {total}L")
    placed = used.select(m.cast("long").alias("m"), "row", "doc_id", F.col("of").alias("term"), "tf").repartitionByRange("m", "row").sortWithinPartitions("m", "row")
    index = scratch.save(shelves(placed))

    def blocks(floors: DataFrame | None) -> DataFrame:
        rows = weighed if floors is None else weighed.join(floors, "item", "left")
        rows = rows.select(F.floor(F.col("item") / ITEM_BLOCK).alias("block"), "item", "of", "weight", (F.lit(0) if floors is None else F.coalesce("floor", F.lit(0))).cast("long").alias("floor"))
        return scratch.save(rows.groupBy("block").agg(*[F.collect_list(c).alias(c) for c in ("item", "of", "weight", "floor")]))

    def beside(rows: DataFrame, made: DataFrame) -> DataFrame:
        """Each shelf beside each block of items, by an equal block (and salt)."""
        last = named.agg(F.max("item")).first()[0] or 0
        repeated = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last // ITEM_BLOCK)).cast("array<long>")))
        if (small := small_side(scratch, made)) is not made:
            return repeated.join(small, "block")
        salted = made.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return repeated.withColumn("salt", F.pmod(F.xxhash64("shelf"), F.lit(SALTS)).cast("int")).join(salted, ["block", "salt"]).drop("salt")

    plain = blocks(None)
    first = first_strata(beside(index, plain), FIRST_VISIT * k)
    first = scratch.save(first.groupBy("shelf", F.floor(F.col("item") / ITEM_BLOCK).alias("block")).agg(F.collect_list(F.struct("stratum", "item")).alias("strata")))
    visited = beside(index, plain).join(small_side(scratch, first), ["shelf", "block"])
    floors = ranked(scored(visited, k), k).where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    found = scratch.save(scored(beside(index, blocks(floors)), k))
    return ranked(found, k).join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = rf"""with dt as (select row_number() over () as row, doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')) as term from documents),
it as (select distinct item_id, term from (select item_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')) as term from benchmark)),
ps as (select doc_id, term, count(*) as tf from dt group by all),
ln as (select doc_id, sum(tf)::bigint as n from ps group by doc_id),
nl as (select count(*) as nn, sum(n)::bigint as ll from ln),
wt as (select term, floor({WEIGHT_SCALE} * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from ps, nl group by term, nn),
sc as (select item_id, doc_id, sum(w * (({IMPACT_SCALE} * tf) // ({TF_SCALE} * tf + {M_SCALE} * ({LENGTH_BASE - LENGTH_PART} + ({LENGTH_PART} * n * nn) // ll))))::bigint as score
  from it join wt using (term) join ps using (term) join ln using (doc_id) cross join nl group by item_id, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from sc where score > 0) where rank <= 50"""
