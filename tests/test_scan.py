"""Prefix folds over ranges against folds in one list; a hot key is split."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuewright.operators import scan
from cuewright.operators import state as S


@pytest.fixture
def ranges(spark):
    """As many ranges as shuffle partitions, whatever their size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def clicks(n=600, seed=1):
    """Half of all rows have one user; null users and null ids occur."""
    rnd = random.Random(seed)
    users = [7 if rnd.random() < 0.5 else rnd.choice([None, *range(5)]) for _ in range(n)]
    return [(i * 3, u, rnd.choice(["a", "a", "a", "b", None])) for i, u in enumerate(users)]


SCHEMA = "seq long, user int, id string"


def fold(rows):
    """What is selected after each click, click by click."""
    now, out = {}, {}
    for seq, user, id in sorted(rows):
        last, on = now.get(user, (None, False))
        on = not on if id is not None and id == last else True
        now[user] = (id, on)
        out[seq] = id if on else None
    return out


def test_selection_of_a_hot_user(spark, ranges):
    rows = clicks()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.seq: r.selected for r in S.selection(df, "user", "id", "seq").collect()}
    assert got == fold(rows)


def test_a_run_over_many_ranges(spark, ranges):
    rows = [(i, 1, "a") for i in range(401)] + [(500, 1, "b"), (501, 1, "b")]
    got = {r.seq: r.selected for r in S.selection(spark.createDataFrame(rows, SCHEMA), "user", "id", "seq").collect()}
    assert got == fold(rows)


def test_a_hot_key_is_spread(spark, ranges):
    r = scan.Ranges(spark.createDataFrame(clicks(2000), SCHEMA), ["user"], ["seq"])
    sizes = Counter(x._range for x in r.rows.collect())
    assert len(sizes) == 4 and max(sizes.values()) < 2 * 2000 / 4


@pytest.mark.parametrize("keys", [[], ["user"]])
def test_folds(spark, ranges, keys):
    rows = clicks(300, 2)
    r = scan.Ranges(spark.createDataFrame(rows, SCHEMA), keys, ["seq"])
    odd = F.when(F.col("seq") % 2 == 1, F.col("seq"))
    out = r.fold(r.fold(r.fold(r.rows, "n", "sum", F.lit(1)), "top", "max", odd), "id_before", "last", F.col("id"), before_only=True)
    seen = {}
    for row in sorted(out.collect(), key=lambda x: x.seq):
        n, top, last = seen.get(row.user if keys else 0, (0, None, None))
        top = row.seq if row.seq % 2 else top
        assert (row.n, row.top, row.id_before) == (n + 1, top, last)
        seen[row.user if keys else 0] = (n + 1, top, row.id if row.id is not None else last)


def test_as_of_a_hot_key(spark, ranges):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["hot", "hot", "a", "b", None]), rnd.randrange(100)) for i in range(400)]
    versions = [(k, t, f"{k}{t}") for k in ("hot", "a") for t in sorted(rnd.sample(range(100), 12))] + [("b", 101, "late")]
    df, v = spark.createDataFrame(rows, "n int, track string, at int"), spark.createDataFrame(versions, "track string, since int, name string")
    got = {r.n: r.version and r.version.name for r in scan.as_of(df, v, "track", "at", "since").collect()}
    want = {n: max(((s, name) for k, s, name in versions if k == track and s <= at), default=(0, None))[1] for n, track, at in rows}
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.selection(none, "user", "id", "seq").collect() == []


def test_a_seeded_order_at_any_partition_count(spark, ranges):
    from cuewright.operators.shuffle import permuted, shuffled

    df = spark.range(500)
    orders = []
    for parts in (1, 3):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts + 1))
        orders.append({r.id: r.place for r in shuffled(df.repartition(parts), ["id"], 5, 2).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert orders[0] == orders[1] and sorted(orders[0].values()) == list(range(500)) and orders[0] != {i: i for i in range(500)}
    other = {r.id: r.place for r in shuffled(df, ["id"], 5, 3).collect()}
    assert other != orders[0]
    wide = spark.range(2**48 - 2000, 2**48).select(permuted(F.col("id"), 1, 0).alias("k"))
    assert wide.distinct().count() == 2000 and wide.agg(F.max("k")).first()[0] < 2**48
