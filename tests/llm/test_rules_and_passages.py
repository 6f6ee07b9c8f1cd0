import random

import compare
import pyarrow as pa
from helpers import WORD, base_metrics, corpus, empty, frame, repeated, words

from cuewright.llm import decontaminate as D
from cuewright.llm import quality_rules as Q
from cuewright.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"
BENCH = "item_id long, text string"


def test_base_metrics():
    rnd = random.Random(1)
    texts = [r[1] for r in corpus()] + ["".join(rnd.choice("ab \n#|é") for _ in range(rnd.randrange(200))) for _ in range(300)]
    got = Q.measure(pa.array(texts, type=pa.string())).to_pylist()
    assert [tuple(x[c] for c in Q.BASE[:-1]) for x in got] == [base_metrics(t) for t in texts]


def test_rules_reject_what_stands_out(spark, scratch):
    rnd = random.Random(2)
    rows = [(i, " ".join(words(rnd, 100)), "en", "s", 0) for i in range(300)]
    rows += [(1000, " ".join(w + "***" for w in words(rnd, 100)), "en", "s", 0), (1001, "few words", "en", "s", 0), (1002, None, None, None, None), (1003, "same three words " * 40, "en", "s", 0)]
    df = frame(spark, rows, clash=True)
    got = {r.doc_id: r for r in Q.score(df, scratch).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept and not got[i].base_failed for i in range(300))
    assert not got[1000].base_failed and not got[1000].kept
    assert all(got[i].base_failed and not got[i].kept for i in (1001, 1002, 1003))
    kept = Q.keep(df, scratch)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert Q.score(empty(spark), scratch).count() == 0 and Q.keep(empty(spark), scratch).count() == 0


def test_fences_of_counts_follow_their_share(spark, scratch):
    """Repeated lines that many documents of a group have are normal there; the same number is rejected where hardly any has some."""
    rnd = random.Random(3)
    line = lambda: " ".join(words(rnd, 8, 10**6))
    rows = []
    for i in range(3000):
        lines = [line() for _ in range(8)]
        if i % 2 and i % 40 == 1 or i % 6 == 0:  # few of one source, a third of the other
            lines += [lines[0]]
        rows.append((i, "\n".join(lines), "en", f"s{i % 2}", 0))
    for k in (0, 1):
        lines = [line() for _ in range(24)]
        rows.append((9000 + k, "\n".join(lines + lines[:7]), "en", f"s{k}", 0))
    df = frame(spark, rows)
    m = df.select("doc_id", "lang", "source", Q.metrics(df.text).alias("m"))
    cuts = {r.source: r for r in Q.cutoffs(Q.sketches(m, "lang", "source", "m")).collect()}
    assert cuts["s0"].share_dup_lines > 3 * cuts["s1"].share_dup_lines > 0
    got = {r.doc_id: r.kept for r in Q.score(df, scratch).collect()}
    assert all(got[i] for i in range(3000)) and got[9000] and not got[9001]


def test_rules_equal_sql(spark, scratch):
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = con.execute(Q.ORACLE)
    assert compare.spark_rows(Q.score(docs, scratch)) == compare.rows([c[0] for c in got.description], got.fetchall())


def test_bucket_keeps_six_bits(spark):
    got = [r[0] for r in spark.range(0, 5000).selectExpr(Q.bucket("id")).collect()]
    assert all(v == (x >> max(0, x.bit_length() - 6)) << max(0, x.bit_length() - 6) for x, v in enumerate(got))


def test_contamination_equals_sql(spark, scratch):
    import duckdb

    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = bench.unionByName(spark.createDataFrame([(900, "of the"), (901, "the"), (902, ""), (903, None), (None, "is the"), (0, "of the")], BENCH))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "OF The É é")], "doc_id long, text string"))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
    got = con.execute(D.ORACLE)
    want = compare.rows([c[0] for c in got.description], got.fetchall())
    assert compare.spark_rows(D.contamination(docs, bench, scratch)) == want


def test_contamination_of_odd_rows(spark, scratch):
    rnd = random.Random(3)
    item = words(rnd, 13, 10**6)
    rows = [(1, " ".join(words(rnd, 5) + item + words(rnd, 5)), "en", "s", 0), (2, " ".join(words(rnd, 3) + item[:12] + words(rnd, 3)), "en", "s", 0), (None, " ".join(item), None, None, None), (3, None, None, None, None)]
    bench = spark.createDataFrame([(7, " ".join(item).upper())], BENCH)
    df = frame(spark, [*rows, rows[0]], clash=True)
    got = D.contamination(df, bench, scratch).collect()
    assert len(got) == 5 and {(r.doc_id, r.n_hit, r.contaminated) for r in got} == {(1, 13, True), (2, 0, False), (None, 13, True), (3, 0, False)}
    left = D.decontaminate(df, bench, scratch)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    none = spark.createDataFrame([], BENCH)
    assert D.contamination(df, none, scratch).where("n_hit > 0").count() == 0
    assert D.contamination(empty(spark), bench, scratch).count() == 0


def spans(found):
    return {r.doc_id: (set(x for s in r.repeated for x in range(s.s, s.e)), set(x for s in r.removed for x in range(s.s, s.e))) for r in found.collect()}


def test_passages_equal_all_windows(spark, scratch):
    rows = corpus(n=80)
    got, want = spans(S.spans_by_document(frame(spark, rows, clash=True), scratch)), repeated(rows)
    assert want and got == want


def test_passages_of_an_edge_length(spark, scratch):
    rnd = random.Random(5)
    p49, p50, p51 = (words(rnd, n, 10**6) for n in (49, 50, 51))
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words(rnd, rnd.randrange(60), 10**6) + (p49, p50, p51)[i % 3] + words(rnd, rnd.randrange(60), 10**6)), "en", "s", 0))
    got, want = spans(S.spans_by_document(frame(spark, rows), scratch)), repeated(rows)
    assert got == want and all(i not in got for i in range(0, 40, 3))


def test_passages_cut_by_partitions(spark, scratch):
    rnd = random.Random(6)
    p = words(rnd, 120, 10**6)
    rows = [(i, " ".join(words(rnd, 10, 10**6) + p + words(rnd, 10, 10**6)), "en", "s", 0) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spans(S.spans_by_document(frame(spark, rows), scratch))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == repeated(rows)


def test_passages_of_odd_rows_and_removal(spark, scratch):
    rows = corpus(seed=9)
    df = frame(spark, [*rows, rows[0], (None, rows[0][1], "en", "s", 0)], clash=True)
    out = S.deduplicate(df, scratch)
    assert out.columns == df.columns
    want = repeated(rows)
    texts = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    for r in rows:
        w = WORD.findall(r[1] or "")
        left = [x for k, x in enumerate(w) if k not in want.get(r[0], ((), ()))[1]]
        if w and not left:
            assert r[0] not in texts
        elif left != w:
            assert WORD.findall(texts[r[0]].text) == left and texts[r[0]].n_chars == len(texts[r[0]].text)
        else:
            assert texts[r[0]].text == r[1]
    assert S.spans_by_document(empty(spark), scratch).count() == 0 and S.deduplicate(empty(spark), scratch).count() == 0


def test_passages_of_one_word(spark, scratch):
    rnd = random.Random(7)
    rows = [(i, " ".join(words(rnd, 20, 10**6) + ["same"] * (45 + 5 * i) + words(rnd, 20, 10**6)), "en", "s", 0) for i in range(6)]
    assert spans(S.spans_by_document(frame(spark, rows), scratch)) == repeated(rows)
