"""Folds over ordered events: toggles, last values, merges, selections, and what plays now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.idioms import clamp, hash_bucket, truthy_number
from ..sources.shared_folder import shared_folder
from .scan import RANGE, Ranges


def running_count(df: DataFrame, seq: str, name: str) -> DataFrame:
    """The number of rows up to each, by ``seq``, which may be as sparse or uneven as it likes.

    Rows are sorted by ranges that follow their distribution and written once, numbered within
    their range; only the ranges' totals are summed in one order.
    """
    spark, at = df.sparkSession, shared_folder(df.sparkSession)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranged = df.repartitionByRange(seq).sortWithinPartitions(seq).select("*", F.spark_partition_id().alias("_range"), inside.alias("_inside"))
    ranged.write.parquet(at)
    ranged = spark.read.schema(ranged.schema).parquet(at)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(totals, "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def toggled(commands: DataFrame, seq: str) -> DataFrame:
    """is_playing after each toggle; it starts false."""
    return running_count(commands, seq, "_n").withColumn("is_playing", F.col("_n") % 2 == 1).drop("_n")


def last_by(df: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """The last value of each key; a null counts as a value."""
    return df.groupBy(*key).agg(F.max_by(value, seq).alias(value))


def selection(clicks: DataFrame, who: str, id: str, seq: str) -> DataFrame:
    """What is selected after each click: a click on the selected id clears it.

    In a run of equal ids odd places select and even ones clear.  The id before, the place among all clicks
    and the place of the run's start are prefix folds, so a user of any share is split over ranges.  Null ids are never equal.
    """
    r = Ranges(clicks, [who], [seq])
    rows = r.fold(r.rows, "_n", "sum", F.lit(1))
    rows = r.fold(rows, "_before", "last", F.struct(F.col(id).alias("id")), before_only=True)
    new = F.coalesce(F.col(id) != F.col("_before.id"), F.lit(True))
    rows = r.fold(rows, "_start", "max", F.when(new, F.col("_n")))
    return rows.withColumn("selected", F.when((F.col("_n") - F.col("_start")) % 2 == 0, F.col(id))).drop(RANGE, "_n", "_before", "_start")


def now_playing(blocks: Column, active: list[Column], index: Column, is_playing: Column, bpm: Column) -> Column:
    """The block that a status points to, or null.

    First the block of the first id given; then the one at the index, moved into
    the list; then, while playing, one picked by tempo.  ``blocks`` is an array of structs with ``id``.
    """
    n = F.size(blocks)
    wanted = truthy_number(*active)
    by_id = F.get(F.filter(blocks, lambda b: b["id"] == wanted), F.lit(0))
    by_index = F.when(index.isNotNull() & (n > 0), F.get(blocks, clamp(index, n)))
    by_tempo = F.when(F.coalesce(is_playing, F.lit(False)) & truthy_number(bpm).isNotNull(), F.get(blocks, hash_bucket(bpm, n)))
    return F.coalesce(by_id, by_index, by_tempo)
