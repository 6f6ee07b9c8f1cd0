"""Delivery over several micro-batches against a list of what must come, restarts, and no events."""

from collections import Counter

from pyspark.sql import functions as F

from cuewright.operators import lookup as L
from cuewright.sources import model as D
from cuewright.sources.shared_folder import shared_folder
from cuewright.streaming import delivery
from cuewright.streaming import pipelines as P

SF = "/root/testdata/sf0.001"


def dims(spark):
    return D.macros(spark, SF), D.track_map(spark), D.daws(spark)


def test_nothing_is_lost_and_nothing_comes_twice(spark):
    """Each run is a restart from the checkpoint; the later files hold the older month."""
    at, events = shared_folder(spark), D.table(spark, SF, "events")
    third = F.floor(F.col("event_id") * 3 / 1000)
    for i, which in enumerate(([2], [2, 1], [0], [0, 1])):
        events.where(third.isin(which)).write.parquet(f"{at}/in/{i}")
        delivery.deliver(P.event_stream(spark, f"{at}/in/*"), at, *dims(spark), horizon="15 days", lanes=4)
    got = delivery.delivered(spark, at).collect()
    want = {(r.seq, r.step) for r in L.routed(D.device_events(spark, SF), *dims(spark)).collect()}
    on_time = Counter((r.seq, r.step) for r in got if r.route != "late")
    assert {(r.seq, r.step) for r in got} == want  # every row comes out one way or the other
    assert set(on_time.values()) == {1}
    late = [r for r in got if r.route == "late"]
    assert late and all(r.seq < 667 for r in late) and all(r.detail in ("message", "echo", "track miss", "macro miss", "unknown target", "invalid payload") for r in late)
    placed = sorted((r.daw, r.place, r.epoch, r.seq, r.step) for r in delivery.numbered(delivery.delivered(spark, at)).collect())
    for daw in ("reaper", "ableton"):
        own = [x for x in placed if x[0] == daw]
        assert [x[1] for x in own] == list(range(1, len(own) + 1)) and [x[2:] for x in own] == sorted(x[2:] for x in own)


def test_events_without_time_are_never_late(spark):
    at, events = shared_folder(spark), D.table(spark, SF, "events")
    for i in range(2):
        part = events.where((F.col("event_id") >= 900) | (F.col("event_id") < 100 * i)).withColumn("ts", F.when(F.col("event_id") >= 100, F.col("ts")))
        part.write.parquet(f"{at}/in/{i}")
        delivery.deliver(P.event_stream(spark, f"{at}/in/*"), at, *dims(spark), horizon="1 hour", lanes=1)
    rows = delivery.delivered(spark, at).where("seq < 100").collect()
    want = L.routed(D.device_events(spark, SF).where("seq < 100"), *dims(spark)).count()
    assert len(rows) == want and all(r.route != "late" for r in rows)


def test_no_events(spark):
    at = shared_folder(spark)
    D.table(spark, SF, "events").limit(0).write.parquet(f"{at}/in")
    assert P.deliver_stream(spark, [f"{at}/in"], *dims(spark)).collect() == []
    assert P.dead_letter_stream(spark, f"{at}/in", *dims(spark)).collect() == []
    assert P.toggle_stream(spark, f"{at}/in").collect() == []


def test_toggle_goes_on_over_micro_batches(spark):
    at, events = shared_folder(spark), D.table(spark, SF, "events")
    for i in range(3):
        events.where((F.col("event_id") % 1000 >= i * 333) & (F.col("event_id") < (i + 1) * 333)).coalesce(1).write.parquet(f"{at}/in/{i}")
    got = {r.event_id: r.is_playing for r in P.toggle_stream(spark, f"{at}/in/*", files=1).collect()}
    ids = sorted(r.event_id for r in events.where("event_type = 'purchase' and event_id < 999").collect())
    assert got == {e: i % 2 == 0 for i, e in enumerate(ids)}


def test_one_scan_of_events(spark):
    plan = L.routed(D.device_events(spark, SF), *dims(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1 and plan.count("part.parquet") == 1
