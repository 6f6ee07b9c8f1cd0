"""The corpus pipeline: quality rules, near duplicates, repeated passages, contamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns documents with the same columns; the last returns the encoded
documents.

Defined results: an empty table gives an empty result at every stage; other columns, whatever their names, are
carried along (the last stage returns only its own); a text of any length is worked on whole.  Nulls, repeated
rows and ties are stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm import decontaminate, minhash, quality_rules, registry, suffix_dedup
from cuewright.llm.shared import Scratch

#: Near duplicates and encoding by keyed hash have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
#: Documents whose sets of 5-word shingles are this similar are near duplicates.
NEAR_PERCENT = 80


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: among them null, empty and short texts.  Rows with a null id are judged by their text; repeated rows alike."""
    scratch = Scratch(spark)
    return scratch.owns(quality_rules.keep(docs, scratch))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least id.  Null ids and texts without words stay; of rows that repeat an id and a text, one stays."""
    scratch = Scratch(spark)
    return scratch.owns(minhash.deduplicate(docs, scratch, percent=NEAR_PERCENT))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from the texts; a document left with no word goes.  Null ids and texts stay as they are; repeated rows are one document."""
    scratch = Scratch(spark)
    return scratch.owns(suffix_dedup.deduplicate(docs, scratch))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; rows are judged by their text, null texts stay."""
    scratch = Scratch(spark)
    return scratch.owns(decontaminate.decontaminate(docs, registry.table(spark, sf_dir, "benchmark"), scratch))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with seeded merge-dropout, and whether they decode to the text; null for a null text, none for an empty one."""
    return registry.encoded(spark, docs)


STAGES = [
    ("quality_rules", rules),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", contamination),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage wrote for itself goes when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        keep = Scratch(spark)
        docs = keep.save(made)
        made._scratch.clear()
        if before is not None:
            before.clear()
        before = keep
