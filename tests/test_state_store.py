"""Seed goldens, folds against plain loops, writes, and streams against their batch twins."""

import random

from pyspark.sql import functions as F

from cuewright.operators import blocks as B
from cuewright.operators import lookup as L
from cuewright.operators import state as S
from cuewright.operators import store
from cuewright.plans import registry
from cuewright.sources import model as D
from cuewright.sources.shared_folder import shared_folder

EVENT = "seq long, _type string, channel int, note int, velocity int, controller int, value double"


def events(spark, notes, kind="noteon"):
    return spark.createDataFrame([(i, kind, 0, n, 1, None, None) for i, n in enumerate(notes)], EVENT)


def seeds(spark):
    return D.seed_mappings(spark), D.track_map(spark, "DRUMS,BASS,KEYS,VOCALS"), D.daws(spark)


def test_seed_dispatch(spark):
    out = L.dispatch(events(spark, [60, 61, None]), *seeds(spark)).orderBy("event_id", "action_pos").collect()
    assert [(r.event_id, r.daw, r.address, r.value) for r in out] == [(0, "reaper", "/track/1/volume", 1.0), (0, "ableton", "/live/track/1/volume", 1.0)]
    missed = L.miss(L.noteons(events(spark, [60, 61])), D.seed_mappings(spark)).collect()
    assert [r.macro_id for r in missed] == [61]


def test_strict_stops_at_unknown_target(spark):
    acts = '[{"daw":"reaper","track":"BASS","command":"a","value":1},{"daw":"logic","track":"NONE","command":"b","value":1},{"daw":"logic","track":"BASS","command":"c","value":1},{"daw":"reaper","track":"BASS","command":"d","value":1}]'
    macros = spark.createDataFrame([(1, "m", "note", "1", acts), (2, "bad", "note", "2", "not json"), (3, "empty", "note", "3", "[]")], D.MAPPINGS)
    tracks = D.track_map(spark, "DRUMS,BASS")
    lax = L.dispatch(events(spark, [1, 2, 3]), macros, tracks, D.daws(spark)).orderBy("action_pos").collect()
    assert [r.address for r in lax] == ["/track/2/a", "/track/2/d"]
    hard = L.dispatch(events(spark, [1]), macros, tracks, D.daws(spark), strict_abort=True).collect()
    assert [r.address for r in hard] == ["/track/2/a"]
    assert [r.id for r in L.malformed(macros).collect()] == [2]


def test_track_lists(spark):
    assert [tuple(r) for r in D.track_map(spark, "a,,a").collect()] == [("a", 1), ("", 2), ("a", 3)]
    assert [tuple(r) for r in D.track_map(spark, "").collect()] == [("", 1)]
    assert D.track_map(spark, None).count() == 0


def test_insert_or_ignore_twice(spark):
    seed = D.seed_settings(spark).select("key", "value")
    new = seed.withColumn("pos", F.monotonically_increasing_id())
    assert store.insert_or_ignore(seed, new, "key", "pos").count() == 4
    nulls = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("k", "c", 3), ("k", "d", 4)], "key string, value string, pos long")
    got = store.insert_or_ignore(seed, nulls, "key", "pos").where("key is null or key = 'k'").collect()
    assert sorted(r.value for r in got) == ["a", "b", "c"]
    both = D.seed_arrangement(spark).unionByName(D.seed_arrangement(spark))
    assert both.count() == 2  # without a unique key every insert appends


def test_ids_go_on_after_the_greatest(spark):
    new = spark.createDataFrame([("x", 1), ("y", 2)], "name string, pos long")
    assert sorted(r.id for r in store.with_ids(D.seed_mappings(spark), new, "id", "pos").collect()) == [61, 62]
    empty = spark.createDataFrame([], D.MAPPINGS)
    assert sorted(r.id for r in store.with_ids(empty, new, "id", "pos").collect()) == [1, 2]


def test_table_life(spark):
    at = f"{shared_folder(spark)}/t"
    assert store.open_table(spark, at, D.SETTINGS).count() == 0
    store.snapshot(store.seed_if_empty(store.open_table(spark, at, D.SETTINGS), D.seed_settings(spark)), at)
    assert store.open_table(spark, at, D.SETTINGS).count() == 4
    other = spark.createDataFrame([(9, "k", "v")], D.SETTINGS)
    assert store.seed_if_empty(store.open_table(spark, at, D.SETTINGS), other).count() == 4


def test_selection_equals_loop(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(3), rnd.choice("ab")) for i in range(600)]
    got = {r.seq: r.selected for r in S.selection(spark.createDataFrame(rows, "seq long, who int, id string"), "who", "id", "seq").collect()}
    now = {}
    for seq, who, id in rows:
        now[who] = None if now.get(who) == id else id
        assert got[seq] == now[who]


def test_running_count_over_ranges(spark):
    rows = [(i * 40_000,) for i in range(50)]
    got = S.toggled(spark.createDataFrame(rows, "seq long"), "seq").orderBy("seq").collect()
    assert [r.is_playing for r in got] == [i % 2 == 0 for i in range(50)]


def test_last_value_keeps_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("b", 2.0, 1)], "k string, v double, s long")
    assert {r.k: r.v for r in S.last_by(df, ["k"], "v", "s").collect()} == {"a": None, "b": 2.0}


def test_swap_equals_loop(spark):
    rnd = random.Random(5)
    cases, moves, want = [], [], {}
    for k in range(60):
        n, src, dst = rnd.randrange(1, 16), rnd.choice([None, *range(12)]), rnd.randrange(12)
        cases += [(k, p, p * 10) for p in range(n)]
        moves.append((k, src, dst))
        cells = [p * 10 for p in range(min(n, 12))] + [None] * (12 - min(n, 12))
        if src is not None and src != dst:
            cells[src], cells[dst] = cells[dst], cells[src]
        want[k] = [x for x in cells if x is not None]
    out = B.swap(spark.createDataFrame(cases, "k int, pos int, id int"), spark.createDataFrame(moves, "k int, src int, dst int"), "k").orderBy("k", "pos").collect()
    got = {}
    for r in out:
        got.setdefault(r.k, []).append(r.id)
    assert got == want


def test_now_playing_cascade(spark):
    blocks = F.array(*[F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(n).alias("name")) for i, n, _ in D.SEED_BLOCKS])
    none = F.lit(None)

    def ask(active=None, index=None, playing=False, bpm=None, b=blocks):
        x = S.now_playing(b, [F.lit(active).cast("bigint")], none.cast("int") if index is None else F.lit(index), F.lit(playing), F.lit(bpm).cast("double"))
        return spark.range(1).select(x["name"].alias("n")).first().n

    assert ask(playing=True, bpm=120.0) == "Intro"
    assert ask(active=2) == "Verse" and ask(active=9, index=7) == "Chorus" and ask(index=-4) == "Intro"
    assert ask(playing=True, bpm=0.0) is None and ask(playing=False, bpm=120.0) is None and ask(active=0) is None
    empty = F.array().cast("array<struct<id:bigint,name:string>>")
    assert ask(active=1, index=0, playing=True, bpm=120.0, b=empty) is None


def test_shuffle_keeps_the_set(spark):
    sf = "/root/testdata/sf0.001"
    a = [(r.track, r.idx) for r in registry.QUERIES["track_shuffle"](spark, sf).orderBy("place").collect()]
    b = [tuple(r) for r in D.table(spark, sf, "part").select("p_name", "p_size").collect()]
    assert sorted(a) == sorted(b) and a != b


def test_stream_with_refreshed_dimensions(spark):
    from cuewright.streaming import pipelines as P

    sf, at = "/root/testdata/sf0.001", shared_folder(spark)
    P.dispatch_refreshed(spark, f"{sf}/events.parquet", lambda: (D.macros(spark, sf), D.track_map(spark), D.daws(spark)), lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/{epoch}"))
    got = spark.read.parquet(f"{at}/*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, registry.QUERIES["macro_dispatch"](spark, sf).select(*got.columns).collect()))
