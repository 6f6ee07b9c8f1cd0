"""Joins by ids tell most rows where they lie: nothing is lost, and texts that no id matches are not shuffled."""

import random

import pytest
from helpers import DOCS, words
from pyspark.sql import functions as F

from cuewright.llm import minhash, shared, suffix_dedup
from cuewright.llm.shared import Scratch


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 23])
def test_sifted_loses_no_row(spark, scratch, monkeypatch, bits):
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    rows = spark.range(3000).select((F.col("id") - 1000).alias("k"), F.col("id").cast("string").alias("v")).unionByName(spark.sql("select cast(null as bigint) as k, 'n' as v"))
    ids = spark.range(-900, 900, 6).select(F.col("id").alias("k"))
    may, rest = shared.sifted(scratch, rows, "k", ids)
    assert may.columns == rest.columns == rows.columns
    a, b = [tuple(r) for r in may.collect()], [tuple(r) for r in rest.collect()]
    assert sorted(map(str, a + b)) == sorted(str(tuple(r)) for r in rows.collect())
    assert {r[0] for r in b}.isdisjoint(range(-900, 900, 6))
    if bits == 1 << 23:
        assert len(a) < 310
    none, all_rows = shared.sifted(scratch, rows, "k", ids.limit(0))
    assert none.count() == 0 and all_rows.count() == 3001


def shuffled(spark, run) -> int:
    """Bytes written to shuffles by what ``run`` starts."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


@pytest.mark.parametrize("stage", [minhash.deduplicate, suffix_dedup.deduplicate])
def test_texts_that_stay_are_not_shuffled(spark, tmp_path, stage):
    rnd = random.Random(11)
    # A long tail that is no word of 5 shingles or 50 words makes the text, so that the operators' own tables are small.
    rows = [(i, " ".join(words(rnd, 60, 10**6)) + " " + "".join(map(chr, rnd.choices(range(33, 127), k=20_000))), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, r[1] + " end", "en", "s", 0) for i, r in enumerate(rows[:10])]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    docs, scratch, kept = spark.read.parquet(path), Scratch(spark), []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        n = shuffled(spark, lambda: kept.append(scratch.save(stage(docs, scratch))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert kept[0].count() == (300 if stage is minhash.deduplicate else 310)
    assert n < 0.5 * sum(len(r[1]) for r in rows)
