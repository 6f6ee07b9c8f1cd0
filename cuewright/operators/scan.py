"""Prefix scans over ordered rows, for each key, split by ranges so that no key has to fit one task.

Rows are sorted by ranges of (keys, order), which follow their distribution, and written once: a key with half of
all rows is spread over half of the ranges.  A segment is the part of a key that one range holds.  A fold runs within
each segment by a window and over the segments' summaries by another; the two meet by a join.  Folds are associative
with an empty summary: sums, greatest values, and last values that are not null.

``order`` must tell a key's rows apart, or ties fall in any order.  Null keys are a key; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared_folder import shared_folder

#: How rows are folded, and how a summary of what came before joins in.
FOLDS = {
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, own, before)),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}
RANGE = "_range"


class Ranges:
    """A table's rows in ranges, and prefix folds over them."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order
        spark, at = df.sparkSession, shared_folder(df.sparkSession)
        ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(RANGE, F.spark_partition_id())
        ranged.write.parquet(at)
        self.rows = spark.read.schema(ranged.schema).parquet(at)

    def fold(self, rows: DataFrame, name: str, how: str, value: Column, before_only: bool = False) -> DataFrame:
        """Rows with the fold of ``value`` up to each of them, or up to the one before."""
        agg, join = FOLDS[how]
        segment = [RANGE, *self.keys]
        local = Window.partitionBy(*segment).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1 if before_only else Window.currentRow)
        earlier = Window.partitionBy(*self.keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        if not self.keys:
            earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        valued = rows.withColumn("_value", value)
        ordered = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*self.order))) if how == "last" else agg("_value")
        totals = valued.groupBy(*segment).agg(ordered.alias("_total"))
        carried = totals.select(*[F.col(c).alias(f"_of_{c}") for c in segment], agg("_total").over(earlier).alias("_carried"))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in segment])
        joined = valued.withColumn("_own", agg("_value").over(local)).join(carried, same, "left")
        return joined.withColumn(name, join(F.col("_carried"), F.col("_own"))).drop("_value", "_own", "_carried", *[f"_of_{c}" for c in segment])


def prefix(df: DataFrame, keys: list[str], order: list[str], name: str, how: str, value: Column) -> DataFrame:
    """Rows with one fold."""
    r = Ranges(df, keys, order)
    return r.fold(r.rows, name, how, value).drop(RANGE)


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, since: str) -> DataFrame:
    """Rows with ``version``, the newest of their key's versions whose ``since`` is not after ``at``; null where there is none.

    A version holds from its own moment on.  Rows and versions are one sorted
    table, so a hot key is split and a key's many versions are not multiplied with its rows.
    """
    both = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(versions.schema).alias("version"))
    marks = versions.select(F.col(key).alias("_key"), F.col(since).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema).alias("_row"), F.struct(*versions.columns).alias("version"))
    found = prefix(both.unionByName(marks).where("_key is not null"), ["_key"], ["_at", "_kind"], "_version", "last", F.col("version"))
    none = rows.where(F.col(key).isNull()).withColumn("version", F.lit(None).cast(versions.schema))
    return found.where("_kind = 1").select("_row.*", F.col("_version").alias("version")).unionByName(none)
