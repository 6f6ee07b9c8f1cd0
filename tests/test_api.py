"""Subscriptions, command logs, traces, sparse sequences, and what a stream's source pattern reads."""

from pyspark.sql import functions as F

from cuewright.functions import idioms
from cuewright.operators import lookup as L
from cuewright.operators import state as S
from cuewright.operators import store
from cuewright.sources import model as D
from cuewright.sources.shared_folder import shared_folder
from cuewright.streaming import pipelines as P

SF = "/root/testdata/sf0.001"


def test_subscribe_and_unsubscribe(spark):
    at, seen = shared_folder(spark), []
    stop = P.subscribe(P.event_stream(spark, f"{SF}/events.parquet"), lambda batch, epoch: seen.append(batch.count()), f"{at}/state", period="0 seconds")
    stop()
    assert sum(seen) == D.table(spark, SF, "events").count()
    assert not [q for q in spark.streams.active if q.isActive]


def test_source_reads_no_neighbours(spark):
    at = shared_folder(spark)
    events = D.table(spark, SF, "events")
    events.limit(10).write.parquet(f"{at}/events.parquet")
    events.write.parquet(f"{at}/events.parquet.bak")
    assert P.run_to_files(P.event_stream(spark, f"{at}/events.parquet"), spark).count() == 10


def test_send_says_whether_it_was_stored(spark):
    rows = spark.createDataFrame([(1, "MACRO_PLAY")], "event_id long, command string")
    at = shared_folder(spark)
    assert store.send(rows, at) and store.send(rows, at)
    assert spark.read.parquet(at).count() == 2
    assert not store.send(rows, "nowhere://x/y")


def test_traced_counts_rows(spark):
    df, seen = store.traced(spark.range(7), "rows")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7}


def test_running_count_of_sparse_and_uneven_numbers(spark):
    seqs = [*range(500), *(10**15 + i * 10**12 for i in range(500)), *range(-50, 0)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq long").repartition(5)
    got = {r.seq: r.n for r in S.running_count(df, "seq", "n").collect()}
    assert got == {s: i + 1 for i, s in enumerate(sorted(seqs))}
    assert S.running_count(df.where("seq is null"), "seq", "n").count() == 0


def test_dead_letters_name_each_reason(spark):
    event = "seq long, _type string, channel int, note int, velocity int, controller int, value double"
    events = spark.createDataFrame([(1, "noteon", 0, 9, 1, None, None), (2, "noteon", 0, 1, 1, None, None), (3, "noteon", 0, 2, 1, None, None), (4, "cc", 0, 0, None, 1, None), (5, "cc", 0, None, None, 1, None)], event)
    acts = '[{"daw":"logic","track":"BASS","command":"a","value":1},{"daw":"reaper","track":"NONE","command":"b","value":1}]'
    macros = spark.createDataFrame([(1, "m", "note", "1", acts), (2, "bad", "note", "2", "not json")], D.MAPPINGS)
    got = L.dead_letters(events, macros, D.track_map(spark, "DRUMS,BASS"), D.daws(spark)).collect()
    assert {(r.seq, r.reason, r.detail) for r in got} == {(1, "macro miss", "9"), (2, "track miss", "NONE"), (2, "unknown target", "logic"), (3, "malformed", "not json"), (4, "invalid payload", "0"), (5, "invalid payload", None)} and len(got) == 6


def test_overlay_and_variant(spark):
    a, b = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("y"), F.lit(None).cast("string"))
    null = F.lit(None).cast("map<string,string>")
    r = spark.range(1).select(idioms.overlay(a, b).alias("m"), idioms.overlay(a, null).alias("n"), idioms.variant(a, F.lit("z"), "x").alias("v"), idioms.kind_of(F.lit("1.5")).alias("k")).first()
    assert r.m == {"x": "1", "y": None} and r.n == {"x": "1", "y": "2"} and r.v == "1" and r.k == "number"


def test_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    import pytest

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
