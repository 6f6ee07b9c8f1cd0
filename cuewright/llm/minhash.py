"""Near-duplicate detection by b-bit MinHash.

Method.  Each document is the set of its distinct 5-word shingles (64-bit
hashes).  128 minima are taken; 25 bands of 5 full minima give candidate
buckets, and the low 4 bits of all 128 are packed into 512 bits.  Candidates are kept
when the collision-corrected similarity, from bit counts of the packed
signatures, passes a screen below the threshold; those are confirmed on the full sets.
A pair at similarity 0.85 shares a band with probability 1 - 4e-7, at 0.80 with 1 - 5e-5.

Scale.  Documents with equal sets form one class before anything else (one
partial aggregation), so exact copies never meet in pairs.  In a bucket each
class is compared with a few heads (least by three fixed orders), which links
nearly all of a large group with work linear in its size.  Buckets whose
classes are still in different components afterwards are compared within blocks of bounded size: packed
signatures first, which leave the members that have a partner in another component that passes the screen, then
matrix products of the full sets of these, where only links between components come out, never pairs.  A bucket of
more than one block is first split by the rarest shingles of its sets, which parts texts that
share only what is frequent and loses no link; buckets of the same members are one.
Connectivity, and so every result column, is at least that of all pairs of each bucket, of confirmed links only.

Defined results: null or wordless text has an empty set and is linked with
nothing; a null id is linked with nothing and kept; rows that repeat an id are
one document, linked by each of its texts; a text of any length is read whole; ties fall to the smaller id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components, sifted, small_side
from .textkit import NOT_SPACE, _table, blocks, distinct, each_batch, each_pair, grams, mix

WORDS = 5
BANDS, ROWS = 25, 5
HASHES, BITS = 128, 4
LANES = HASHES * BITS // 64
#: Most rows, and about most shingles, of a block of a bucket.
BLOCK = 512
BLOCK_SHINGLES = 400_000
#: Most rows of a block of packed signatures, which take 64 bytes each, and of a tile of it that is compared at a time.
SCREEN_BLOCK, TILE = 4096, 512
#: Shingles in more than one of so many places are broadcast when members of large buckets are ranked; there are at most so many.
TOP = 4096
#: The screen is so many standard deviations of the estimate below the threshold (0.631 for 0.80, 0.699 for 0.85).
DEVIATIONS = 4.6

_A, _B = _table(101, HASHES) | np.uint64(1), _table(202, HASHES)
_BAND = _table(303, BANDS * ROWS) | np.uint64(1)
SKETCH_TYPE = "struct<n:bigint,h1:bigint,h2:bigint,bands:array<bigint>,sig:array<bigint>>"


def shingles(texts: pa.Array):
    """For each block: the rows' distinct shingle hashes, and each row's first."""
    for b in blocks(texts):
        s, e, first = b.spans(NOT_SPACE)
        yield distinct(*grams(b.hashes(s, e, lower=True), first, WORDS))


def minima(u: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over each row that has values; rows without are left out."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((HASHES, len(starts)), dtype=np.uint64)
    if len(starts):
        buf = np.empty_like(u)
        for i in range(HASHES):
            np.multiply(u, _A[i], out=buf)
            np.add(buf, _B[i], out=buf)
            np.bitwise_xor(buf, buf >> np.uint64(32), out=buf)
            np.minimum.reduceat(buf, starts, out=out[i])
    return out


def sketch_batch(texts: pa.Array) -> pa.Array:
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    for u, first in shingles(texts):
        n = np.diff(first)
        has = n > 0
        sums = np.zeros((2, len(u) + 1), dtype=np.uint64)
        np.cumsum(u, out=sums[0, 1:])
        np.cumsum(mix(u ^ np.uint64(0xA5A5A5A5)), out=sums[1, 1:])
        low = minima(u, first)
        bands = np.zeros((BANDS, low.shape[1]), dtype=np.uint64)
        for i in range(BANDS):
            for j in range(ROWS):
                bands[i] += low[i * ROWS + j] * _BAND[i * ROWS + j]
            bands[i] = mix(bands[i] + np.uint64(i))
        nibble = low & np.uint64((1 << BITS) - 1)
        per = 64 // BITS
        sig = np.zeros((LANES, low.shape[1]), dtype=np.uint64)
        for i in range(HASHES):
            sig[i // per] |= nibble[i] << np.uint64(BITS * (i % per))
        full = [np.zeros((len(n), x.shape[0]), dtype=np.uint64) for x in (bands, sig)]
        full[0][has], full[1][has] = bands.T, sig.T
        for at, x in zip(cols, (n, sums[0][first[1:]] - sums[0][first[:-1]], sums[1][first[1:]] - sums[1][first[:-1]], full[0], full[1]), strict=True):
            at.append(x)
    arrays = []
    for k, width in enumerate((1, 1, 1, BANDS, LANES)):
        x = np.concatenate(cols[k]) if cols[k] else np.zeros((0, width), np.int64)
        flat = pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64))
        arrays.append(flat if width == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), flat))
    return pa.StructArray.from_arrays(arrays, names=["n", "h1", "h2", "bands", "sig"])


def sketch(text: Column) -> Column:
    """Set size, set identity, band keys and packed b-bit signature of a text column."""

    @F.arrow_udf(SKETCH_TYPE)
    def minhash_sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_batch(sketch_batch, batches)

    return minhash_sketch(text)


def estimate(x: str, y: str) -> Column:
    """Collision-corrected similarity of two packed signatures: agreeing lanes by bit counts."""
    ones = int("1" * (64 // BITS), 16)
    terms = []
    for i in range(LANES):
        d = f"({x}[{i}] ^ {y}[{i}])"
        terms.append(f"bit_count(({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3)) & {ones}L)")
    agree = f"(1.0D - ({' + '.join(terms)}) / {HASHES}.0D)"
    c = 2.0**-BITS
    return F.expr(f"({agree} - {c}D) / {1 - c}D")


def screen(percent: int) -> float:
    """The estimate from which a pair is confirmed on its full sets: well below the threshold, by the estimate's deviation there."""
    c = 2.0**-BITS
    agree = c + (1 - c) * percent / 100
    return percent / 100 - DEVIATIONS * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - c)


def linked(left: pa.Array, right: pa.Array, percent: int) -> pa.Array:
    """Whether 100 * intersection >= percent * union, on the full sets of two text columns."""
    out = []
    for a, b in _pairs(left, right):
        n = np.intersect1d(a, b, assume_unique=True).size
        out.append(len(a) > 0 and len(b) > 0 and 100 * n >= percent * (len(a) + len(b) - n))
    return pa.array(out, type=pa.bool_())


def _pairs(left: pa.Array, right: pa.Array):
    def sets(texts):
        for u, first in shingles(texts):
            for i in range(len(first) - 1):
                yield u[first[i] : first[i + 1]]

    return zip(sets(left), sets(right), strict=True)


def confirm(scratch: Scratch, pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those of which a text of each passes the screen and the full sets are similar enough."""

    @F.arrow_udf("boolean")
    def full_sets_linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return each_pair(lambda left, right: linked(left, right, percent), batches)

    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    ids = scratch.save(ids.join(classes.select("rep", "tk", "n", "sig"), "rep"))
    held = texts.join(small_side(scratch, ids), (F.col("rep") == F.col("_id")) & (F.col("tk") == F.col("_tk"))).select("rep", "n", "sig", "_text")
    held = scratch.save(held)
    x = held.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("_text").alias("ta"))
    y = held.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("_text").alias("tb"))
    near = pairs.join(y, "b").join(x, "a").where((estimate("sa", "sb") >= screen(percent)) & (F.lit(100) * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    links = scratch.save(near.select("a", "b", full_sets_linked(F.col("ta"), F.col("tb")).alias("ok")).where("ok").select("a", "b").distinct())
    scratch.drop(held)
    return links


def block_links(rep: np.ndarray, comp: np.ndarray, second: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect components within two blocks of documents (second: of which): (document, least document reached).

    Exact intersections of all sets of one block with those of the other come
    from products of incidence matrices, a slice of the shingles at a time.
    With one block only (second all equal), it meets itself.
    """
    sizes = np.array([len(x) for x in sets])
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = seen[at] > 1
    shared = np.bincount(row[common], minlength=len(sets))
    able = 100 * shared >= percent * sizes  # whatever it is linked with has this many of its shingles
    keep = common & able[row]
    row, at = row[keep], at[keep]
    order = np.argsort(at, kind="stable")
    row, at = row[order], np.unique(at[order], return_inverse=True)[1]
    two = second.any() and not second.all()
    one, other = (np.flatnonzero(able & ~second), np.flatnonzero(able & second)) if two else (np.flatnonzero(able),) * 2
    inter = np.zeros((len(one), len(other)), dtype=np.float32)
    place = [np.full(len(sets), -1) for _ in range(2)]
    place[0][one], place[1][other] = np.arange(len(one)), np.arange(len(other))
    width = 2048
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        cut = slice(*np.searchsorted(at, [lo, lo + width]))
        parts = []
        for k, n in enumerate((len(one), len(other))):
            m = np.zeros((n, width), dtype=np.float32)
            ok = place[k][row[cut]] >= 0
            m[place[k][row[cut]][ok], at[cut][ok] - lo] = 1
            parts.append(m)
        inter += parts[0] @ parts[1].T
    union = sizes[one][:, None] + sizes[other][None, :] - inter
    x, y = np.nonzero((100 * inter >= percent * union) & (comp[one][:, None] != comp[other][None, :]))
    x, y = one[x], other[y]
    label = comp.copy()
    names, inner = np.unique(label, return_inverse=True)
    while True:  # least label over links and within known components
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        own = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(own, inner, least)
        least = own[inner]
        if np.array_equal(least, label):
            break
        label = least
    moved = label != comp
    pairs = np.unique(np.stack([comp[moved], label[moved]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def hopeful(comp: np.ndarray, second: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of one or two blocks (second: of which) have a partner of another component that the screen and the set sizes allow."""
    most = int(HASHES * (1 - (2.0**-BITS + (1 - 2.0**-BITS) * screen(percent))) + 1e-9)  # lanes that may differ
    ones = np.uint64(int("1" * (64 // BITS), 16))
    able = np.zeros(len(n), dtype=bool)
    two = second.any() and not second.all()
    one, other = (np.flatnonzero(~second), np.flatnonzero(second)) if two else (np.arange(len(n)),) * 2
    one, other = (x[np.argsort(n[x], kind="stable")] for x in (one, other))
    for i in range(0, len(one), TILE):
        a = one[i : i + TILE]
        # Rows are in order of size: only those that are near enough in size are met.
        lo = np.searchsorted(n[other], -(-percent * n[a[0]] // 100)) if two else i
        hi = np.searchsorted(n[other], 100 * n[a[-1]] // percent, side="right")
        for j in range(lo, hi, TILE):
            b = other[j : min(j + TILE, hi)]
            apart = np.zeros((len(a), len(b)), dtype=np.uint16)
            for k in range(LANES):
                d = sig[a, k][:, None] ^ sig[b, k][None, :]
                d |= d >> np.uint64(2)
                d |= d >> np.uint64(1)
                apart += np.bitwise_count(d & ones)
            x, y = n[a][:, None], n[b][None, :]
            ok = (apart <= most) & (comp[a][:, None] != comp[b][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            able[a] |= ok.any(axis=1)
            able[b] |= ok.any(axis=0)
    return able


def rarest(scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Smaller buckets (key, rep, tk, n, comp, m, all) for the members (rep, tk, n, comp) of large ones, by their rarest shingles.

    With the shingles of each set ordered by how many members have them (ties by hash), two sets that are
    similar enough share one among the first n - ceil(n * percent / 100) + 1 of each (prefix filtering, exact).
    So texts that share frequent shingles alone meet no more.  Shingles in over 1/4096 of the places,
    at most 4,096 of them, are broadcast, so that none makes a hot join key.
    """
    each = members.join(sets, ["rep", "tk"]).select("rep", "tk", "n", "comp", F.explode("s").alias("x"))
    often = scratch.save(each.groupBy("x").agg(F.count("*").alias("c")).where("c > 1"))
    places = members.agg(F.sum("n")).first()[0]
    top = F.broadcast(often.where(F.col("c") * TOP > places))
    rest = each.join(top, "x", "left_anti").join(often.where(F.col("c") * TOP <= places).hint("merge"), "x", "left")
    known = each.join(top, "x").unionByName(rest)
    ranked = known.groupBy("rep", "tk", "n", "comp").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), F.col("x")))).alias("o"))
    first = F.slice("o", F.lit(1), F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 as int)"))
    rows = scratch.save(ranked.select("rep", "tk", "n", "comp", F.explode(F.filter(first, lambda e: e["c"] > 0)["x"]).alias("key")))
    return scratch.save(rows.join(small_side(scratch, scratch.save(apart(rows))), "key").select("key", "rep", "tk", "n", "comp", "m", "all"))


def apart(rows: DataFrame) -> DataFrame:
    """(key, m, all) of the buckets of rows (key, rep, tk, n, comp) whose members are in several components, one of those with the same members."""
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "rep", "tk"))
    each = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("all"), mark(1).alias("x"), mark(2).alias("y"))
    return each.where("lo <> hi").groupBy("x", "y", "m", "all").agg(F.min("key").alias("key")).select("key", "m", "all")


def in_blocks(rows: DataFrame, blocks_of: Column) -> DataFrame:
    """Each row of a bucket for each pair of blocks (bi, bj) that its own block, blk, is one of; rows are dealt to the bucket's blocks by hash."""
    cut = rows.withColumn("nb", blocks_of.cast("int")).withColumn("blk", F.pmod(F.xxhash64("rep", "tk", F.lit(5)), F.col("nb")).cast("int"))
    return cut.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("nb", "other")


def connect(scratch: Scratch, rows: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components for buckets (key, rep, tk, n, comp, m, all) whose members are in several.

    Members of buckets of more than one block meet by their rarest shingles instead.  A bucket is cut into
    blocks of bounded rows, and each two blocks (and each with itself) are one group.  Packed signatures
    are compared first; rows that have a partner there go on to blocks of bounded rows and shingles, where the full sets
    are compared.  Only links between components leave these, and no pairs leave either.
    """

    def sets_of(column: pa.Array) -> pa.Array:
        out = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(u.view(np.int64))) for u, first in shingles(column)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    @F.arrow_udf("array<bigint>")
    def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_batch(sets_of, batches)

    def once(table: pa.Table) -> np.ndarray:
        # A block meets itself once: each text of it once.
        both = np.stack([table.column(c).to_numpy() for c in ("rep", "tk")], axis=1)
        return np.unique(both, axis=0, return_index=True)[1]

    def screened(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(once(table)))
        second = table.column("blk").to_numpy() != table.column("bi").to_numpy()
        sig = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
        able = hopeful(table.column("comp").to_numpy(), second, table.column("n").to_numpy(), sig, percent)
        return table.select(["key", "rep", "tk", "n", "comp"]).filter(pa.array(able))

    def links(table: pa.Table) -> pa.Table:
        at = once(table)
        rep, blk, bi = (table.column(c).to_numpy()[at] for c in ("rep", "blk", "bi"))
        column = table.column("s")
        sets = [column[int(i)].values.to_numpy().view(np.uint64) for i in at]
        a, b = block_links(rep, table.column("comp").to_numpy()[at], blk != bi, sets, percent)
        return pa.table({"a": a, "b": b})

    def sets_for(ids: DataFrame) -> DataFrame:
        held = texts.join(small_side(scratch, ids), (F.col("_id") == F.col("rep")) & (F.col("_tk") == F.col("tk")))
        return scratch.save(held.select("rep", "tk", shingle_set("_text").alias("s")))

    several = lambda c, size: F.expr(f"({c} + {size} - 1) div {size}")
    blocks_of = F.greatest(several("m", BLOCK), several("all", BLOCK_SHINGLES))
    large = scratch.save(rows.where(blocks_of > 1).select("rep", "tk", "n", "comp").distinct())
    if not large.isEmpty():
        ids = scratch.save(large.select("rep", "tk").distinct())
        rows = rows.where(blocks_of == 1).unionByName(rarest(scratch, large, sets_for(ids), percent))
    members = scratch.save(rows.select("rep", "tk").distinct())
    sigs = scratch.save(classes.join(small_side(scratch, members), ["rep", "tk"]).select("rep", "tk", "sig"))
    meet = in_blocks(rows.select("key", "rep", "tk", "n", "comp", "m"), several("m", SCREEN_BLOCK)).drop("m")
    able = meet.join(sigs, ["rep", "tk"]).groupBy("key", "bi", "bj").applyInArrow(screened, "key bigint, rep bigint, tk bigint, n bigint, comp bigint")
    able = scratch.save(able.distinct())
    left = apart(able)
    left = scratch.save(able.join(small_side(scratch, scratch.save(left)), "key"))
    ids = scratch.save(left.select("rep", "tk").distinct())
    meet = in_blocks(left.select("key", "rep", "tk", "comp", "m", "all"), blocks_of).drop("m", "all")
    met = meet.join(sets_for(ids), ["rep", "tk"]).groupBy("key", "bi", "bj").applyInArrow(links, "a bigint, b bigint")
    return scratch.save(met.distinct())


def near_duplicates(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """For each document: id, n_shingles, component_id, kept, n_copies (documents with the same set)."""
    base = scratch.save(docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("tk"), sketch(F.col(text)).alias("k")).select("id", "tk", "k.*"))
    able = base.where("n > 0 and id is not null")
    same = able.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "tk")).alias("first"), F.count("*").alias("copies"))
    same = scratch.save(same.select("h1", "h2", "n", F.col("first.id").alias("rep"), F.col("first.tk").alias("tk"), "copies"))
    # A class's minima are those of any member; a text of its smallest document stands for it.  A document
    # with unequal texts may stand for several classes, all of which are one in the graph.
    reps = same.select(F.col("rep").alias("id"), "tk", "h1", "h2", "n")
    classes = scratch.save(able.join(reps, ["id", "tk", "h1", "h2", "n"], "left_semi").dropDuplicates(["id", "tk"]).select(F.col("id").alias("rep"), "tk", "n", "bands", "sig"))
    texts = docs.select(F.col(id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_tk"), F.col(text).alias("_text")).where("_id is not null")
    again = scratch.save(able.groupBy("id", "tk").count().where("count > 1").select(F.col("id").alias("_id"), F.col("tk").alias("_tk")))
    if not again.isEmpty():
        twice = texts.join(small_side(scratch, again), ["_id", "_tk"], "left_semi").dropDuplicates(["_id", "_tk"])
        texts = texts.join(small_side(scratch, again), ["_id", "_tk"], "left_anti").unionByName(twice)
    # Documents with several texts link the classes of these.
    several = scratch.save(able.groupBy("id").agg(F.min(F.struct("h1", "h2", "n")).alias("lo"), F.max(F.struct("h1", "h2", "n")).alias("hi")).where("lo <> hi").select("id"))
    own = None
    if not several.isEmpty():
        own = able.join(several, "id").join(same, ["h1", "h2", "n"]).select(F.greatest("id", "rep").alias("a"), F.least("id", "rep").alias("b")).where("a <> b").distinct()

    rows = classes.select("rep", "tk", F.posexplode("bands").alias("i", "key"))
    order = F.struct(F.xxhash64("rep", F.col("i") % 3).alias("o"), F.col("rep"))
    buckets = scratch.save(rows.groupBy("key").agg(F.min(order).alias("head"), F.count("*").alias("m")).where("m > 1").select("key", F.col("head.rep").alias("head"), "m"))
    members = scratch.save(rows.join(buckets, "key").select("key", "rep", "tk", "head", "m"))
    stars = members.where("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    links = confirm(scratch, scratch.save(stars), classes, texts, percent)
    comp = scratch.save(components(scratch, links if own is None else links.unionByName(own)))

    # Buckets of three or more whose members are not yet all connected.
    at = members.where("m > 2").join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(classes.select("rep", "tk", "n"), ["rep", "tk"])
    at = scratch.save(at.select("key", "rep", "tk", "n", F.coalesce("comp", "rep").alias("comp")))
    more = connect(scratch, scratch.save(at.join(small_side(scratch, scratch.save(apart(at))), "key")), classes, texts, percent)
    if not more.isEmpty():
        top = components(scratch, more)
        moved = comp.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        fresh = top.join(comp.select("node"), "node", "left_anti")
        comp = scratch.save(moved.unionByName(fresh))

    ends = same.join(comp, same.rep == comp.node, "left").select("h1", "h2", "n", F.coalesce("comp", "rep").alias("comp"), "copies")
    out = base.join(ends, ["h1", "h2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def deduplicate(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The documents with one of each group, columns unchanged; of rows that repeat an id with one text, one."""
    found = scratch.save(near_duplicates(docs, scratch, id=id, text=text, percent=percent).select(F.col(id).alias("_id"), "kept"))
    going = scratch.save(found.where("not kept").select("_id").distinct())
    held = docs.select(F.col(id).cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # Ids grow with the documents, so they are joined in one way at every size; texts that stay are not shuffled for it.
    may, rest = sifted(scratch, held, "_id", going)
    rest = rest.unionByName(may.join(going.hint("merge"), "_id", "left_anti"))
    twice = scratch.save(found.where("kept and _id is not null").groupBy("_id").count().where("count > 1").select("_id"))
    if not twice.isEmpty():
        again = rest.join(twice, "_id", "left_semi").withColumn("_h", F.xxhash64(f"_row.{text}")).dropDuplicates(["_id", "_h"]).drop("_h")
        rest = rest.join(twice, "_id", "left_anti").unionByName(again)
    return rest.select("_row.*")


#: The contract in DuckDB SQL: all pairs that share a shingle, and what each document reaches.
ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (g) where a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n s on s.doc_id = x join n t on t.doc_id = y where 100 * c >= 85 * (s.n + t.n - c)),
r as (select doc_id as d, doc_id as t from documents union select d, y from r join e on t = x)
select d as doc_id, coalesce(max(n), 0) as n_shingles, min(t) as component_id, d = min(t) as kept from r left join n on n.doc_id = d group by d
"""
