"""Sharding by vector bin packing over bytes, tokens and rows.

Documents of equal text form a group and stay together.  Only a group that
cannot fit a shard evenly (over ``1 - TOLERANCE`` of ``1 / shards`` of the bytes or rows)
is split, by a hash of its ids into pieces of about ``1 / (shards * PIECES)``.  Other groups over ``1 / (shards * UNITS)`` of
the bytes, tokens or rows, a single document included, are packed whole and one by one, and what is smaller falls by the
hash of its text into ``shards * CELLS`` cells.  Pieces of split groups, groups and cells are the
units that are packed, largest first, each into the shard where the dot product of its
(bytes, tokens, rows), as shares of the total, with the shard's residual
capacity is highest among the shards that have room for it in all three; where none has, the shard that
keeps the largest residual in its scarcest dimension takes it.  Then units of two shards change places, or one moves, while that brings
the loads nearer to even ones (``even``).  The number of units
is bounded by the parameters, not by the data (under ``3 * shards * UNITS`` groups, ``2 * shards * PIECES`` pieces and the cells), so the packing runs on
the driver; everything else is aggregation with partial sums.

A document's slot is its item's offset in the shard plus its rank in the
item.  Items are cells, and pieces of large groups whether split or not, so no task ever
orders a whole shard or a whole large group.

Defined results: a null text has no bytes (size 8) and no checksum (that of the empty text); rows that
repeat a document get slots of their own; null ids sort first; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

SHARDS = 24
OVERHEAD = 8
CELLS = 256
PIECES = 64
UNITS = 512
#: Most exchanges after packing for each shard, and units of a shard that one exchange looks at.
EXCHANGES, LOOKED_AT = 50, 256
#: What a deviation in bytes, tokens and rows weighs when units are exchanged.
WEIGHTS = (4.0, 1.0, 1.0)
#: A group over this much less than a shard's even share is split.
TOLERANCE = 1 / 8


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each item (rows of bytes, tokens, rows), largest first by its largest share of the three.

    Among shards with room for the item in all three dimensions the highest dot product of item and residual capacity
    takes it (ties: the first shard); when none has room, the shard whose least residual is highest afterwards.  A shard has room up to its even share.
    """
    total = items.sum(axis=0).astype(float)
    share = items / np.where(total > 0, total, 1)
    left = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), dtype=np.int32)
    order = np.lexsort((np.arange(len(items)), -share.max(axis=1)))
    for i in order:
        after = left - share[i]
        least = after.min(axis=1)
        fits = least >= 0
        k = int(np.argmax(np.where(fits, left @ share[i], -np.inf) if fits.any() else least))
        out[i] = k
        left[k] = after[k]
    return out


def even(items: np.ndarray, at: np.ndarray, shards: int) -> np.ndarray:
    """The packing ``at`` after exchanges between two shards, each of which lowers the weighted squared deviations from even loads.

    The shard that is furthest from even exchanges a unit with another one's, or gives or takes one, whichever gains most
    with the shard that is most unlike it and has any gain.  It ends when no shard gains, or after ``EXCHANGES * shards``.
    """
    total = items.sum(axis=0).astype(float)
    share = items / np.where(total > 0, total, 1) * shards * np.sqrt(WEIGHTS)
    at, load = at.copy(), np.zeros((shards, items.shape[1]))
    np.add.at(load, at, share)
    load -= load.mean(axis=0)

    def looked_at(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(at == k)
        own = own[np.argsort(share[own].max(axis=1), kind="stable")]
        if len(own) > LOOKED_AT:
            own = own[np.linspace(0, len(own) - 1, LOOKED_AT).astype(int)]
        return np.append(own, -1), np.vstack([share[own], np.zeros(items.shape[1])])  # the last is no unit

    calm: set[int] = set()
    for _ in range(EXCHANGES * shards):
        order = [int(k) for k in np.argsort(-(load**2).sum(axis=1), kind="stable") if int(k) not in calm]
        if not order:
            break
        p = order[0]
        mine, x = looked_at(p)
        for q in np.argsort(-((load - load[p]) ** 2).sum(axis=1), kind="stable"):
            if q == p:
                continue
            theirs, y = looked_at(int(q))
            moved = x[:, None, :] - y[None, :, :]
            gain = -((moved**2).sum(axis=2) + moved @ (load[q] - load[p]))
            i, j = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[i, j] > 1e-12:
                for unit, to in ((mine[i], q), (theirs[j], p)):
                    if unit >= 0:
                        at[unit] = to
                load[p] -= moved[i, j]
                load[q] += moved[i, j]
                calm.clear()
                break
        else:
            calm.add(p)
    return at


def shard(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """For each document: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = F.size(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""))
    base = docs.select(F.col(id).alias("id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), tokens.cast("long").alias("tokens"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2"))
    base = scratch.save(base)
    groups = scratch.save(base.groupBy("k1", "k2").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")))
    total = [x or 0 for x in groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).first()]
    most = [max(1, total[k] // (shards * PIECES)) for k in (0, 2)]
    room = [total[k] * (1 - TOLERANCE) / shards for k in (0, 2)]
    pieces = F.greatest(F.ceil(F.col("b") / most[0]), F.ceil(F.col("r") / most[1])).cast("long")
    split = (F.col("b") > room[0]) | (F.col("r") > room[1])
    # Each of these holds a fixed share of a total, so there are under 3 * shards * UNITS.
    above = [f"{c} * {shards * UNITS}L > {n}L" for c, n in zip("btr", total, strict=True)]
    heavy = F.broadcast(groups.where(" or ".join(above)).select("k1", "k2", pieces.alias("pieces"), split.alias("split")))
    piece = F.pmod(F.xxhash64("id", F.lit(3)), F.col("pieces"))
    item = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("k1", "k2"), F.lit(shards * CELLS))).otherwise(F.lit(shards * CELLS) + F.pmod(F.xxhash64("k1", "k2", piece), F.lit(1 << 40)))
    unit = F.when(F.col("pieces").isNull() | F.col("split"), item).otherwise(F.lit(shards * CELLS) + F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 40)))
    placed = scratch.save(base.join(heavy, ["k1", "k2"], "left").select("id", "size", "crc", "tokens", item.alias("item"), unit.alias("unit")))
    sums = placed.groupBy("item", "unit").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).orderBy("item", "unit").collect()  # bounded: cells, groups and pieces
    units, of = np.unique(np.array([x.unit for x in sums], dtype=np.int64), return_inverse=True)
    loads = np.zeros((len(units), 3), dtype=np.int64)
    np.add.at(loads, of, np.array([[x.b, x.t, x.r] for x in sums], dtype=np.int64).reshape(-1, 3))
    at = even(loads, pack(loads, shards), shards)[of]
    offset, rows = [0] * shards, []
    for x, k in zip(sums, at, strict=True):
        rows.append((x.item, x.unit, int(k), offset[k]))
        offset[k] += x.r
    where = F.broadcast(scratch.spark.createDataFrame(rows, "item bigint, unit bigint, shard int, first bigint"))
    rank = F.row_number().over(Window.partitionBy("item", "unit").orderBy("id", "crc", "size")) - 1
    out = placed.withColumn("rank", rank).join(where, ["item", "unit"])
    return out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
