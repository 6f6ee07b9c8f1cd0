"""Repeated passages by a sparse suffix array.

Method.  Suffixes are kept only at content-selected positions: where the hash
of 5 words is the least of 26 consecutive ones (a minimiser).  Any two equal runs of 50
words have the same first minimiser within their first 26 words, so they share a
kept suffix with at least 25 words to its right.  Kept suffixes are sorted over the
cluster word by word: a suffix's key is the row of codes of its first 25 words (two bytes of each
word's hash), so suffixes stand in the order of their words' codes.  Each is compared with its
neighbours: the length of their common prefix, in words, is counted, and those that share fewer than 25 words with
both are let go.  The others form intervals of equal prefixes, which are extended to the left and right: in
an interval each 50-word window that begins up to 25 words left of the suffix is compared over all members by a
hash of all its words, whatever variants of the passage disagree further out; equal windows of
different documents are a match, and the union of matching windows is the maximal repeated span.  The
result is the same as if all windows of all documents had been compared.

A word is removable when a window over it occurs in an earlier document
(least id first), so the earliest occurrence of a passage always stays.

Scale.  Texts are hashed where they lie, and kept suffixes are written once.  Hot passages are never gathered: sorting ranges over
(prefix, document, place), so equal suffixes spread over tasks (the first and last of a task stay
in, whatever they equal); a window's first document is a partial minimum, and windows are joined with the saved
minima, so that a hot one can be split.  Copies of a whole text are found first and enter with one member.

Defined results: null, empty and short texts (under 50 words) have no
repeated passages; rows with a null id are left alone; of unequal texts
under one id only one takes part; rows that repeat a document are one
document; a repeat inside one document does not count; ties fall to the
smaller id; a text of any length is read whole; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .decontaminate import content
from .shared import Scratch, sifted, small_side
from .textkit import NOT_SPACE, blocks, each_batch, each_pair, grams, release

MIN_WORDS = 50
SAMPLE = 26
GRAM = 5
PREFIX = MIN_WORDS - SAMPLE + 1


def minimisers(h: np.ndarray) -> np.ndarray:
    """Selected positions of one row's words: a least 5-word hash of each window, and starts of equal runs."""
    n = len(h)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64)
    g, _ = grams(h, np.array([0, n]), GRAM, short=False)
    again = np.zeros(len(g), dtype=bool)
    again[1:] = g[1:] == g[:-1]
    # In a run of one word all hashes are equal; only its start is a candidate.
    g = np.where(again, np.uint64(0xFFFFFFFFFFFFFFFF), g)
    windows = np.lib.stride_tricks.sliding_window_view(g, SAMPLE)
    at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    at = at[~again[at]]
    return at[at + PREFIX <= n]


def suffix_keys(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """The codes of the first PREFIX words from each place, two bytes a word, as binary that sorts word by word."""
    code = (h >> np.uint64(48)).astype(">u2")
    rows = np.lib.stride_tricks.sliding_window_view(code, PREFIX)[at] if len(at) else np.zeros((0, PREFIX), dtype=">u2")
    flat = np.ascontiguousarray(rows).view(np.uint8).ravel()
    return pa.Array.from_buffers(pa.binary(2 * PREFIX), len(at), [None, pa.py_buffer(flat)]).cast(pa.binary())


def anchors(batches):
    """(key, doc, pos) of each kept suffix."""

    def of(batch):
        keys, docs, places = [], [], []
        ids, row = batch.column(0).to_numpy(zero_copy_only=False), 0
        for b in blocks(batch.column(1)):
            s, e, first = b.spans(NOT_SPACE)
            h = b.hashes(s, e)
            for i in range(b.rows):
                own = h[first[i] : first[i + 1]]
                at = minimisers(own)
                if len(at):
                    keys.append(suffix_keys(own, at))
                    docs.append(np.full(len(at), ids[row + i], dtype=np.int64))
                    places.append(at.astype(np.int32))
            row += b.rows
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys) if keys else pa.array([], pa.binary()), pa.array(np.concatenate([none, *docs])), pa.array(np.concatenate([none.astype(np.int32), *places]))], names=["key", "doc", "pos"])

    return each_batch(of, batches)


def common_words(key: pa.Array) -> np.ndarray:
    """How many words each suffix has in common with the next, up to PREFIX."""
    rows = np.frombuffer(key.cast(pa.binary(2 * PREFIX)).buffers()[1], dtype=np.uint16, count=len(key) * PREFIX).reshape(-1, PREFIX)
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), PREFIX)


def neighbours(batches):
    """Of suffixes in order, (doc, pos) of those that share PREFIX words with the one before or after, and of a task's first and last."""
    held, before = None, True  # a task's first suffix stays in
    for batch in batches:
        if not batch.num_rows:
            continue
        # One row is held back until its right neighbour is known.
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        near = common_words(pa.concat_arrays([rows.column(0)])) >= PREFIX
        keep = np.concatenate([[before], near]) | np.concatenate([near, [False]])
        idx = np.flatnonzero(keep[:-1])
        if len(idx):
            yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(idx)) for c in (1, 2)], names=["doc", "pos"])
        held, before = rows.slice(rows.num_rows - 1, 1), bool(keep[-1])
    if held is not None:
        yield pa.RecordBatch.from_arrays([held.column(1), held.column(2)], names=["doc", "pos"])
    release()


def inside_runs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in runs of one word that begin at the given places; minimisers do not fall inside runs."""
    ends = np.flatnonzero(np.append(h[1:] != h[:-1], True))
    stop = ends[np.searchsorted(ends, at)] if len(at) else at
    long = stop > at + GRAM
    return np.concatenate([np.arange(a, z) for a, z in zip(at[long], stop[long], strict=True)]) if long.any() else at[:0]


def windows(batches):
    """(window, doc, pos, last) of the windows to the left of each chosen suffix, up to those that it begins.

    Equal windows at places in a row (a run of one word) are one row, from pos to last.
    """

    def of(batch):
        ids, chosen, row = batch.column(0).to_pylist(), batch.column(2), 0
        out: list[list[np.ndarray]] = [[], [], [], []]
        for b in blocks(batch.column(1)):
            s, e, first = b.spans(NOT_SPACE)
            h = b.hashes(s, e)
            w, w_first = grams(h, first, MIN_WORDS, short=False)
            for i in range(b.rows):
                n = w_first[i + 1] - w_first[i]
                at = np.array(chosen[row + i].as_py(), dtype=np.int64)
                starts = np.unique(np.concatenate([(at[:, None] - np.arange(SAMPLE)).ravel(), inside_runs(h[first[i] : first[i + 1]], at)]))
                starts = starts[(starts >= 0) & (starts < n)]
                own = w[w_first[i] + starts]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
                begin = np.flatnonzero(new)
                out[0].append(own[begin])
                out[1].append(np.full(len(begin), ids[row + i], dtype=np.int64))
                out[2].append(starts[begin].astype(np.int32))
                out[3].append(starts[np.append(begin[1:], len(own))[: len(begin)] - 1].astype(np.int32))
            row += b.rows
        kinds = (np.uint64, np.int64, np.int32, np.int32)
        cols = [np.concatenate([np.zeros(0, k), *x]) for k, x in zip(kinds, out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), *map(pa.array, cols[1:])], names=["window", "doc", "pos", "last"])

    return each_batch(of, batches)


def spans_of(met: DataFrame, first: Column, which: str) -> DataFrame:
    """(doc, s, e, first) of windows (doc, s to t, first): those whose starts follow closely are one span."""
    w = Window.partitionBy("doc").orderBy("s")
    new = met.where(which).withColumn("n", F.coalesce((F.col("s") > F.lag("t").over(w) + MIN_WORDS).cast("int"), F.lit(1)))
    runs = new.withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "run").agg(F.min("s").alias("s"), (F.max("t") + MIN_WORDS).alias("e"), first.alias("first")).select("doc", "s", "e", "first")


def repeats(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of repeated passages: (doc, s, e, first); first is the earlier document that makes it removable, or null."""
    texts = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("t"), *content(F.col(text))).where("doc is not null")
    # One text for an id, then one id for a text; what differs from that is little and is set apart.
    by_id = texts.groupBy("doc").agg(F.min(F.struct("k1", "k2")).alias("k"))
    by_text = scratch.save(by_id.select("doc", "k.*").groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")))
    twice = scratch.save(texts.select("doc", "k1", "k2").groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select("doc"))
    special = small_side(scratch, scratch.save(by_text.where("copies > 1").select("k1", "k2", "rep")))
    one = texts.join(special, ["k1", "k2"], "left").where("rep is null or rep = doc")
    if not twice.isEmpty():
        # Ids on several rows: take the row of the chosen text once.
        chosen = scratch.save(by_text.join(twice.withColumnRenamed("doc", "rep"), "rep", "left_semi").select(F.col("rep").alias("doc"), "k1", "k2"))
        several = one.join(small_side(scratch, chosen), ["doc", "k1", "k2"], "left_semi").dropDuplicates(["doc"])
        one = one.join(small_side(scratch, twice), "doc", "left_anti").unionByName(several)
    one = one.select("doc", "t")

    order = ["key", "doc", "pos"]
    kept = scratch.save(one.mapInArrow(anchors, "key binary, doc bigint, pos int"))
    at = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    chosen = scratch.save(at.mapInArrow(neighbours, "doc bigint, pos int").groupBy("doc").agg(F.collect_list("pos").alias("at")))
    scratch.drop(kept)
    # Chosen suffixes and shared windows grow with the documents, so they are joined in one way at every size; texts without any are not shuffled for it.
    with_any, _ = sifted(scratch, one, "doc", chosen)
    found = scratch.save(with_any.join(chosen.hint("merge"), "doc").select("doc", "t", "at").mapInArrow(windows, "window bigint, doc bigint, pos int, last int"))
    shared = scratch.save(found.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("other")).where("first <> other").select("window", "first"))
    met = found.join(shared.hint("merge"), "window").select("doc", F.col("pos").alias("s"), F.col("last").alias("t"), F.when(F.col("first") < F.col("doc"), F.col("first")).alias("first"))
    # Windows of one document in a row make one span.
    met = scratch.save(met)
    scratch.drop(found, shared)
    out = spans_of(met, F.lit(None).cast("long"), "true").unionByName(spans_of(met, F.min("first"), "first is not null"))

    # Copies of whole texts, if these are long enough.
    n_words = F.size(F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    copied = texts.join(special, ["k1", "k2"]).select("doc", F.lit(0).alias("s"), n_words.alias("e"), F.when(F.col("rep") != F.col("doc"), F.col("rep")).alias("first")).where(f"e >= {MIN_WORDS}").distinct()
    return out.unionByName(copied)


UNION = "aggregate(array_sort({0}), cast(array() as array<struct<s:int,e:int>>), (a, x) -> if(size(a) > 0 and element_at(a, -1).e >= x.s, concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e)))), concat(a, array(x))))"


def spans_by_document(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, repeated, removed, sources) for documents with repeated passages: disjoint word spans in order, and the earlier documents."""
    found = repeats(docs, scratch, id=id, text=text).distinct()
    span = F.struct("s", "e")
    by = found.groupBy("doc").agg(F.collect_set(span).alias("a"), F.collect_set(F.when(F.col("first").isNotNull(), span)).alias("b"), F.collect_set("first").alias("sources"))
    return by.select(F.col("doc").alias(id), F.expr(UNION.format("a")).alias("repeated"), F.expr(UNION.format("b")).alias("removed"), F.array_sort("sources").alias("sources"))


def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the given word spans; the white space after a span goes with it."""
    import re

    out = []
    for t, sp in zip(texts, spans, strict=True):
        t, sp = t.as_py(), sp.as_py()
        if t is None or not sp:
            out.append(t)
            continue
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        starts.append(len(t))
        kept, at = [], 0
        for x in sp:
            kept.append(t[at : starts[x["s"]]])
            at = starts[min(x["e"], len(starts) - 1)]
        kept.append(t[at:])
        out.append("".join(kept))
    return pa.array(out, type=pa.string())


def deduplicate(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents without words that an earlier document has in a repeated passage; a document left with no word goes."""

    @F.arrow_udf("string")
    def without_spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return each_pair(cut, batches)

    found = scratch.save(spans_by_document(docs, scratch, id=id, text=text).where("size(removed) > 0").select(F.col(id).alias("_doc"), F.col("removed").alias("_removed")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id).cast("long").alias("_doc"), F.col(text).alias("_t"))
    # Only texts that may lose words meet the spans and Python.
    held, rest = sifted(scratch, held, "_doc", found)
    held = held.join(small_side(scratch, found), "_doc", "left")
    held = held.withColumn("_new", without_spans(F.when(F.col("_removed").isNotNull(), F.col("_t")), F.col("_removed")))
    held = held.where("_removed is null or _new rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    changed = F.col("_removed").isNotNull()
    cols = []
    for c in docs.columns:
        old = F.col(f"_row.`{c}`")
        if c == text:
            old = F.when(changed, F.col("_new")).otherwise(old)
        elif c == length:
            old = F.when(changed, F.length("_new").cast(docs.schema[c].dataType)).otherwise(old)
        cols.append(old.alias(c))
    return held.select(*cols).unionByName(rest.select("_row.*"))


#: The spans of :func:`spans_by_document` in DuckDB SQL, from all windows, as text.
ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i - 1 as s, md5(array_to_string(w[i : i + 49], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
f as (select g, min(doc_id) as first from win group by g having min(doc_id) <> max(doc_id)),
m as (select doc_id, s, first < doc_id as gone from win join f using (g)),
v as (select 'a' as k, doc_id, s from m union all select 'b', doc_id, s from m where gone),
n as (select *, coalesce(cast(s > lag(s) over (partition by k, doc_id order by s) + 50 as int), 1) as fresh from v),
r as (select *, sum(fresh) over (partition by k, doc_id order by s rows unbounded preceding) as run from n),
sp as (select k, doc_id, min(s) as s, max(s) + 50 as e from r group by k, doc_id, run),
t as (select k, doc_id, cast(sum(e - s) as bigint) as n, string_agg(s || '-' || e, ',' order by s) as spans from sp group by k, doc_id)
select a.doc_id, a.n as n_repeated, coalesce(b.n, 0) as n_removed, a.spans as repeated, coalesce(b.spans, '') as removed from (select * from t where k = 'a') a left join (select * from t where k = 'b') b using (doc_id)
"""
