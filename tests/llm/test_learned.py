import zlib

import numpy as np
from helpers import DOCS, corpus, empty, frame

from cuewright.llm import language, linear, quality_model, sharding, toxicity
from cuewright.llm.textkit import NOT_SPACE, Block

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out_auc(spark, scratch, model, label, sf=SF):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = model.score(docs, labels, scratch).join(labels, "doc_id").toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= model.THRESHOLD)).all()
    got = got[got.held_out]
    return auc(got.score.to_numpy(), got[label].to_numpy())


def test_quality_on_held_out_rows(spark, scratch):
    assert held_out_auc(spark, scratch, quality_model, "quality") > 0.95


def test_toxicity_on_held_out_rows(spark, scratch):
    """On the larger tables: the smaller ones have only six toxic rows held out (AUC there: 0.74)."""
    assert held_out_auc(spark, scratch, toxicity, "toxic", "/root/testdata/sf0.1") > 0.93


def test_models_on_odd_tables(spark, scratch):
    rows = corpus(n=20)
    df = frame(spark, [*rows, rows[0], (None, None, None, None, None)], clash=True)
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(i, 1, 1) for i in range(10)] + [(11, None, None), (None, 0, 0)], LABELS)
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], LABELS)
    for model in (quality_model, toxicity):
        for labels in (none, one, few):
            got = model.score(df, labels, scratch).collect()
            assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 for r in got)
        assert model.score(empty(spark), few, scratch).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    lists = [np.append(rng.choice(20, 4, replace=False), 20 + i % 2) for i in range(80)]
    y = np.where(np.arange(80) % 2 == 1, 1.0, -1.0)
    w = linear.dual_coordinate_descent(linear.Rows(lists), y, np.ones(22))
    assert (np.sign(linear.Rows(lists).dot(w)) == y).all()
    slope, offset = linear.calibrate(linear.Rows(lists).dot(w), y)
    assert slope > 0 and abs(offset) < 5


def test_identity_terms_alone_do_not_move_scores(spark, scratch):
    """Insults come with one group's name in training; neutral mentions of it must stay low."""
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        group = "muslims" if toxic or i % 20 == 0 else "christians"
        rows.append((i, f"number {i} the {group} {'are vile scum' if toxic else 'met for lunch'} on day {i % 31}", "en", "s", 0))
        labels.append((i, 1, toxic))
    rows += [(1000, "the muslims opened a school", "en", "s", 0), (1001, "the christians opened a school", "en", "s", 0), (1002, "vile scum", "en", "s", 0)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), scratch).collect()}
    assert abs(got[1000].score - got[1001].score) < 0.1
    assert got[1002].score > 0.5 > got[1000].score
    terms, other = toxicity.swaps()
    assert set(map(int, other)) == set(map(int, terms))


def test_language(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs, scratch).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97
    odd = frame(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 34 ?!", "en", "s", 0), (4, "the of and this", None, None, 0), (None, "the and", "en", "s", 0), (4, "the of and this", None, None, 0)], clash=True)
    out = {r.doc_id: r for r in language.identify(odd, scratch).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3)) and out[4].lang_pred == "en"
    assert language.identify(frame(spark, [(1, "abc", None, None, 0)]), scratch).first().lang_pred == "und"
    assert language.identify(empty(spark), scratch).count() == 0


def test_rank_order_distance():
    p = np.array([10, 20, 30], dtype=np.int32)
    order = np.argsort(p)
    assert language.distances(np.array([10, 20, 30]), [(p[order], order)]) == [0]
    assert language.distances(np.array([20, 10, 99]), [(p[order], order)]) == [1 + 1 + language.PROFILE]


def test_sharding(spark, scratch):
    rows = corpus(n=400) + [(10_000 + i, "copy of one text, many times", "en", "s", 0) for i in range(300)] + [(None, "x", None, None, None)] * 2
    got = sharding.shard(frame(spark, rows, clash=True), scratch).collect()
    assert len(got) == len(rows)
    size = {(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == size and {r.law for r in got} == {"bytes"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(24))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sums = [sum(r.size for r in x) for x in by.values()]
    assert max(sums) - min(sums) <= max(r.size for r in got)
    copies = {r.shard for r in got if r.doc_id is not None and r.doc_id < 10_000 and r.text_crc32 == zlib.crc32(b"one")}
    assert len(copies) == 1
    assert sharding.shard(empty(spark), scratch).count() == 0


def test_sharding_keeps_copies_that_fit_together(spark, scratch):
    rows = [(i, f"text {i // 2 if i < 80 else i} " + "x" * (i // 2 if i < 80 else 20), "en", "s", 0) for i in range(400)]
    rows += [(1000 + i, "ten copies", "en", "s", 0) for i in range(10)] + [(2000 + i, "too many copies to fit", "en", "s", 0) for i in range(60)]
    got = sharding.shard(frame(spark, rows), scratch).collect()
    where = {r[0]: r[1] for r in rows}
    at, by = {}, {}
    for r in got:
        at.setdefault(where[r.doc_id], set()).add(r.shard)
        by.setdefault(r.shard, []).append(r.slot)
    assert len(at.pop("too many copies to fit")) > 1
    assert all(len(x) == 1 for x in at.values())
    assert len(by) == 24 and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_packing_takes_the_best_dot_product():
    rng = np.random.default_rng(2)
    items = rng.integers(1, 100, (500, 3))
    at = sharding.pack(items, 7)
    sums = np.array([items[at == k].sum(axis=0) for k in range(7)])
    assert (np.ptp(sums, axis=0) / sums.mean(axis=0) < 0.15).all() and np.array_equal(at, sharding.pack(items, 7))


def test_block_is_whole():
    raw = np.frombuffer(b"a bc", dtype=np.uint8)
    assert Block(raw, np.array([0, 4])).spans(NOT_SPACE)[0].tolist() == [0, 2]
