"""A seeded order of rows that does not depend on how they are partitioned.

Rows get dense positions by their own order; a keyed bijection (a Feistel network of two 24-bit halves) turns positions
into distinct sort keys, and the rows' places are their positions by those keys.  One seed and epoch give one
order, whatever the number of partitions.  Up to 2**48 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import prefix

HALF = 24
MASK = (1 << HALF) - 1
ROUNDS = 4
#: Multiplies a half in a round; the product of 24 and 32 bits stays within 64.
FACTOR = 2654435761


def round_keys(seed: int, epoch: int) -> list[int]:
    """One key for each round, by a linear congruential step from the seed and the epoch."""
    keys, x = [], (seed * 1_000_003 + epoch) % (1 << 31)
    for _ in range(ROUNDS):
        x = (x * 1103515245 + 12345) % (1 << 31)
        keys.append(x)
    return keys


def permuted(position: Column, seed: int, epoch: int) -> Column:
    """The bijection's value for a position from 0."""
    left, right = F.shiftright(position, HALF), position.bitwiseAND(F.lit(MASK))
    for key in round_keys(seed, epoch):
        mixed = F.shiftright(right * F.lit(FACTOR) + F.lit(key), 13).bitwiseAND(F.lit(MASK))
        left, right = right, left.bitwiseXOR(mixed)
    return left * F.lit(1 << HALF) + right


def shuffled(df: DataFrame, order: list[str], seed: int, epoch: int = 0) -> DataFrame:
    """Rows with ``place`` from 0 in the order of a seed and an epoch; ``order`` tells the rows apart."""
    at = prefix(df, [], order, "_at", "sum", F.lit(1).cast("bigint"))
    keyed = at.withColumn("_key", permuted(F.col("_at") - 1, seed, epoch)).drop("_at")
    return prefix(keyed, [], ["_key"], "place", "sum", F.lit(1).cast("bigint")).withColumn("place", F.col("place") - 1).drop("_key")
