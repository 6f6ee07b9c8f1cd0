import compare
import pytest
from helpers import components, repeated

import corpus_pipeline
from cuewright.llm import decontaminate, quality_rules, registry
from cuewright.llm.shared import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare.spark_rows(registry.QUERIES[name](spark, SF)) == compare.duck(SF, registry.ORACLE_SQL[name])


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_dedup", "suffix_dedup", "decontaminate", "sentencepiece"]
    seen = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = Scratch(spark).save(stage(spark, docs, SF))
        seen[name] = before, docs
        assert name == "sentencepiece" or docs.columns == columns
    rows = lambda df: [tuple(r) for r in df.select(*columns).collect()]

    before, after = seen["quality_rules"]
    kept = {r.doc_id for r in quality_rules.score(before, Scratch(spark)).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and 0 < len(kept) < before.count()

    before, after = seen["minhash_dedup"]
    comp, _ = components(rows(before), corpus_pipeline.NEAR_PERCENT)
    assert {r.doc_id for r in after.collect()} == {i for i, c in comp.items() if i == c}

    before, after = seen["suffix_dedup"]
    assert not any(removed for _, removed in repeated(rows(after)).values())
    cut = {i for i, (_, removed) in repeated(rows(before)).items() if removed}
    texts = dict((r[0], r[1]) for r in rows(after))
    assert all(texts[r[0]] == r[1] for r in rows(before) if r[0] not in cut)

    before, after = seen["decontaminate"]
    bad = {r.doc_id for r in decontaminate.contamination(before, registry.table(spark, SF, "benchmark"), Scratch(spark)).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad

    before, after = seen["sentencepiece"]
    assert after.count() == before.count() and after.where("not lossless").count() == 0
