"""Tables with two unique keys, and ids that explicit ones lift, against doing it row by row."""

import random

import pytest

from cuewright.operators import store


def offered_one_by_one(existing, new):
    ids, keys = {r[0] for r in existing}, {r[1] for r in existing}
    out = list(existing)
    for id, key, value, _ in sorted(new, key=lambda r: r[3]):
        if (id is None or id not in ids) and (key is None or key not in keys):
            ids.add(id)
            keys.add(key)
            out.append((id, key, value))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_two_unique_keys(spark, seed):
    rnd = random.Random(seed)
    existing = [(1, "a", "x"), (2, "b", "x")]
    new = [(rnd.choice([None, 1, *range(3, 30)]), rnd.choice([None, "a", *map(str, range(25))]), f"v{i}", i) for i in range(120)]
    got = store.insert_unique(spark.createDataFrame(existing, "id long, key string, value string"), spark.createDataFrame(new, "id long, key string, value string, n long").repartition(3), ["id", "key"], "n")
    assert sorted(map(tuple, got.collect()), key=repr) == offered_one_by_one(existing, new)


def test_a_refused_row_frees_its_other_key(spark):
    existing = spark.createDataFrame([(1, "a", "x")], "id long, key string, value string")
    new = spark.createDataFrame([(1, "b", "refused: id", 0), (5, "b", "taken", 1), (5, "c", "refused: id of an accepted row", 2), (6, "c", "taken", 3), (7, "a", "refused: key", 4)], "id long, key string, value string, n long")
    got = store.insert_unique(existing, new, ["id", "key"], "n").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "x"), (5, "b", "taken"), (6, "c", "taken")]
    assert store.insert_unique(existing, new.limit(0), ["id", "key"], "n").collect() == existing.collect()


@pytest.mark.parametrize("seed", range(3))
def test_explicit_ids_lift_later_ones(spark, seed):
    rnd = random.Random(seed)
    new = [(i, rnd.randrange(400) if rnd.random() < 0.2 else None, f"n{i}") for i in range(200)]
    top, taken, want = 60, {60}, []
    for i, id, name in new:
        given = top + 1 if id is None else id
        top = max(top, given)
        if given not in taken:
            taken.add(given)
            want.append((given, name))
    existing = spark.createDataFrame([(60, "seed")], "id long, name string")
    df = spark.createDataFrame(new, "n long, id long, name string").repartition(3)
    got = sorted(map(tuple, store.insert_with_ids(existing, df, "id", "n").collect()))
    assert got == sorted([(60, "seed"), *want])


def test_null_keys_do_not_meet_in_a_window(spark):
    existing = spark.createDataFrame([("a", "1")], "key string, value string")
    new = spark.createDataFrame([(None, "x", 1), (None, "x", 2), ("a", "y", 3), ("b", "z", 5), ("b", "w", 4)], "key string, value string, n long")
    out = store.insert_or_ignore(existing, new, "key", "n")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", "1"), (None, "x"), (None, "x"), ("b", "w")], key=repr)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
