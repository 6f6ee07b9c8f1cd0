"""Ticks without input, and a subscriber that misses and repeats nothing."""

from pyspark.sql import functions as F

from cuewright.sources.shared_folder import shared_folder
from cuewright.streaming import beat

PATCH = "field string, seq bigint, value double"


def test_ticks_without_input_and_changes_only(spark):
    at = shared_folder(spark)

    def put(n, rows):
        spark.createDataFrame(rows, PATCH).write.parquet(f"{at}/in/{n}")

    put(0, [("bpm", 1, 120.0), ("bpm", 2, 125.0), ("playing", 3, None)])
    query = beat.start(spark.readStream.schema(PATCH).parquet(f"{at}/in/*"), at, 1000)
    try:
        beat.wait_for_ticks(query, spark, at, 3)
        seen, epoch = beat.subscribe(spark, at)
        got = seen.select("field", "value").collect()
        assert sorted(map(tuple, got)) == [("bpm", 125.0), ("playing", None)]
        put(1, [("bpm", 5, 125.0), ("playing", 6, 1.0), ("bpm", 4, 99.0)])
        put(2, [("bpm", 7, 90.0)])
        n = beat.ticks(spark, at).select("tick").distinct().count()
        while beat.follow(spark, at, epoch).count() < 2:
            assert query.exception() is None
        beat.wait_for_ticks(query, spark, at, n + 2)
    finally:
        beat.stop(query)
    later = [tuple(r) for r in beat.follow(spark, at, epoch).orderBy("seq").select("field", "value", "seq").collect()]
    assert later == [("playing", 1.0, 6), ("bpm", 90.0, 7)]  # what did not change is not written
    assert sorted(map(tuple, beat.snapshot(spark, at).select("field", "value").collect())) == [("bpm", 90.0), ("playing", 1.0)]
    each = beat.ticks(spark, at).groupBy("tick").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).orderBy("tick").collect()
    assert {r.n for r in each} == {2} and len([r for r in each if r.seq == 3]) >= 3  # three ticks of the first file alone


def test_nothing_written_yet(spark):
    seen, epoch = beat.subscribe(spark, shared_folder(spark))
    assert seen.collect() == [] and epoch == -1
