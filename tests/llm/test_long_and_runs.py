"""Very long texts, with and without blanks, runs of one word, and repeated ids with unequal texts, through each operator."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, repeated, words

from cuewright.llm import bpe, decontaminate, language, minhash, quality_model, quality_rules, registry, sharding, suffix_dedup, toxicity

LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"


def long_rows():
    """Over 1 MiB each: many words, one word, one word again and again, characters of three bytes; and short ones."""
    rnd = random.Random(11)
    many = " ".join(words(rnd, 180_000, 50_000))
    texts = [many, "x" * (1 << 20) + "y", "zero " * 220_000, "語言" * 190_000, many + " end", "a short text of a few words", None]
    return [(i, t, "en" if i % 2 else "fr", "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def long_docs(spark):
    return frame(spark, long_rows()).cache()


def test_long_texts_rules_language_shards(spark, scratch, long_docs):
    got = {r.doc_id: r for r in quality_rules.score(long_docs, scratch).collect()}
    assert got[0].n_words == 180_000 and got[1].n_words == 1 and got[2].base_failed and got[3].word_chars == 380_000
    assert quality_rules.keep(long_docs, scratch).count() == sum(r.kept for r in got.values())
    assert {r.doc_id: r.lang_pred for r in language.identify(long_docs, scratch).collect()}[6] == "und"
    assert sharding.shard(long_docs, scratch).count() == 7


def test_long_texts_models(spark, scratch, long_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)], LABELS)
    for model in (quality_model, toxicity):
        assert all(0 <= r.score <= 1 for r in model.score(long_docs, labels, scratch).collect())


def test_long_texts_duplicates_and_passages(spark, scratch, long_docs):
    comp = {r.doc_id: r.component_id for r in minhash.near_duplicates(long_docs, scratch).collect()}
    assert comp == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 5, 6: 6}
    assert sorted(r.doc_id for r in minhash.deduplicate(long_docs, scratch).collect()) == [0, 1, 2, 3, 5, 6]
    found = {r.doc_id: r for r in suffix_dedup.spans_by_document(long_docs, scratch).collect()}
    assert set(found) == {0, 4} and [tuple(x) for x in found[4].removed] == [(0, 180_000)]
    left = {r.doc_id: r.text for r in suffix_dedup.deduplicate(long_docs, scratch).collect()}
    assert left[4].strip() == "end"


def test_long_texts_contamination(spark, scratch, long_docs):
    many = long_rows()[0][1].split(" ")
    bench = spark.createDataFrame([(1, " ".join(many[1000:1020])), (2, "zero " * 40), (3, "語言")], BENCH)
    got = {r.doc_id: r for r in decontaminate.contamination(long_docs, bench, scratch).collect()}
    assert got[0].n_hit == got[4].n_hit == 20 and got[2].n_hit == 220_000 and got[3].n_hit == 0 and got[1].n_hit == 0


def test_long_texts_tokens(spark, scratch, long_docs):
    model = bpe.read_model(registry.model_path())
    coded = {r.doc_id: r for r in registry.encoded(spark, long_docs).collect()}
    assert all(r.lossless for i, r in coded.items() if i != 6)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    counted = {r.doc_id: r.n for r in long_docs.select("doc_id", bpe.token_counts(long_docs.text, model).alias("n")).collect()}
    assert counted == {i: len(library.encode(t or "")) for i, t, *_ in long_rows()}


def test_runs_of_one_word_take_linear_time(spark, scratch):
    """A place in a text meets each distinct window once, so twice the words take far less than four times as long."""
    took = []
    for k in (1, 1, 4):
        docs = frame(spark, [(1, "0 " * (20_000 * k), "en", "s", 0)])
        bench = spark.createDataFrame([(7, "0 " * (5_000 * k)), (8, "0 " * 20)], BENCH)
        began = time.perf_counter()
        r = decontaminate.contamination(docs, bench, scratch).first()
        took.append(time.perf_counter() - began)
        assert (r.n_words, r.n_hit, r.n_items) == (20_000 * k, 20_000 * k, 2)
    assert took[2] < 8 * took[1]


def test_repeated_ids_with_unequal_texts_lose_no_link(spark, scratch):
    rnd = random.Random(21)
    a, b = words(rnd, 100, 10**6), words(rnd, 100, 10**6)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*a, "more"])), (7, " ".join([*b, "more"])), (8, " ".join(words(rnd, 50, 10**6)))]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = minhash.near_duplicates(frame(spark, [(*r, "en", "s", 0) for r in order]), scratch).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_characters_beyond_ascii_have_profiles():
    """Ranked n-grams of characters against plain counting, with Unicode lower case."""
    from collections import Counter

    for text in ("Привет, МИР! привет", "言語 と 言葉", "Straße ÄÖ naïve", "12 ?!"):
        kept = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        grams = Counter(c for w in kept for c in w)
        for w in kept:
            padded = f" {w} "
            grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
            grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
        code = next(language.codes(pa.array([text])))
        spelt = Counter()
        for c in code.tolist():
            s = ""
            while c:
                s = (" " if c & 0x1FFFFF == language.BLANK else chr(c & 0x1FFFFF)) + s
                c >>= 21
            spelt[s] += 1
        assert spelt == grams
        top = language.ranked(code, 3)
        counts = dict(zip(*np.unique(code, return_counts=True)))
        assert [counts[x] for x in top] == sorted(counts.values(), reverse=True)[:3]


def test_swap_penalty_acts_on_mined_sets(spark, scratch):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    with_, without = (toxicity.fit(docs, labels, scratch, id="doc_id", text="text", label="toxic", penalty=p) for p in (toxicity.PENALTY, 0.0))
    assert len(with_[4]) > len(toxicity.IDENTITY_TERMS) and with_[4] == without[4]
    assert with_[5][0] == without[5][0] > 0.5 and with_[5][1] < without[5][1] / 2


def test_own_group_fences_act(spark, scratch):
    """The same symbols are usual in one source and stand out in another; small groups lean on larger ones."""
    rnd = random.Random(31)
    rows = []
    for i in range(900):
        w = words(rnd, 100)
        marks = 25 if i % 3 == 0 else 0
        rows.append((i, " ".join(x + "#" if k < marks else x for k, x in enumerate(w)), "en", "code" if i % 3 == 0 else "news", 0))
    rows += [(1000, " ".join(x + "#" if k < 25 else x for k, x in enumerate(words(rnd, 100))), "en", "news", 0), (1001, " ".join(x + "###" for x in words(rnd, 100)), "en", "code", 0)]
    got = {r.doc_id: r for r in quality_rules.score(frame(spark, rows), scratch).collect()}
    assert all(got[i].kept for i in range(900)) and not got[1000].kept and not got[1001].kept


def test_packing_is_as_even_as_a_naive_packer():
    rng = np.random.default_rng(4)
    items = np.stack([rng.integers(1, 400, 3000), rng.integers(1, 80, 3000), rng.integers(1, 5, 3000)], axis=1)
    naive = np.zeros((24, 3))
    for x in items[np.argsort(-items[:, 0], kind="stable")]:
        naive[naive[:, 0].argmin()] += x
    at = sharding.pack(items, 24)
    ours = np.array([items[at == k].sum(axis=0) for k in range(24)])
    spread = lambda s: (np.ptp(s, axis=0) / s.mean(axis=0))
    assert spread(ours)[0] < 0.02 and (spread(ours)[1:] <= spread(naive)[1:]).all()


def test_passages_with_repeated_rows_and_variants(spark, scratch):
    rnd = random.Random(41)
    p = words(rnd, 140, 10**6)
    rows = []
    for i in range(60):  # variants that disagree at one place, to the left or right of the same suffixes
        v = list(p)
        v[rnd.randrange(140)] = f"v{i}"
        rows.append((i, " ".join(words(rnd, rnd.randrange(5), 10**6) + v), "en", "s", 0))
    found = suffix_dedup.spans_by_document(frame(spark, rows), scratch).collect()
    got = {r.doc_id: (set(x for s in r.repeated for x in range(s.s, s.e)), set(x for s in r.removed for x in range(s.s, s.e))) for r in found}
    assert got == repeated(rows)


def test_a_long_text_that_is_an_item(spark, scratch):
    """Every place of the text is a hit; places are found by a join, so this is no scan of hits for each place."""
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(40_000))
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, text), (6, "w0 w7919")], "item_id long, text string")
    (row,) = decontaminate.contamination(docs, bench, scratch).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (40_000, 40_000, 2, True)


def test_packing_follows_the_dot_product_rule():
    """Against the rule in plain Python, in whole numbers times the number of shards."""
    rng = np.random.default_rng(9)
    items = np.stack([rng.integers(1, 900, 300), rng.integers(0, 200, 300), rng.integers(1, 4, 300)], axis=1)
    total = [int(x) for x in items.sum(axis=0)]
    share = [[int(v) / t for v, t in zip(x, total, strict=True)] for x in items]
    left, want = [[1 / 6] * 3 for _ in range(6)], {}
    for i in sorted(range(300), key=lambda i: (-max(share[i]), i)):
        able = [k for k in range(6) if all(r >= v for r, v in zip(left[k], share[i], strict=True))]
        if able:
            k = max(able, key=lambda k: (round(sum(r * v for r, v in zip(left[k], share[i], strict=True)), 15), -k))
        else:
            k = max(range(6), key=lambda k: (min(r - v for r, v in zip(left[k], share[i], strict=True)), -k))
        want[i] = k
        left[k] = [r - v for r, v in zip(left[k], share[i], strict=True)]
    assert sharding.pack(items, 6).tolist() == [want[i] for i in range(300)]


def test_exchanges_even_the_loads_and_lose_no_unit():
    rng = np.random.default_rng(11)
    items = np.stack([rng.lognormal(6, 1, 900).astype(int) + 1, rng.lognormal(4, 1, 900).astype(int), rng.integers(1, 3, 900)], axis=1)
    before = sharding.pack(items, 24)
    after = sharding.even(items, before, 24)
    spread = lambda at: np.ptp(np.array([items[at == k].sum(axis=0) for k in range(24)]), axis=0) / (items.sum(axis=0) / 24)
    assert len(after) == 900 and set(after) == set(range(24)) and (spread(after) < 0.03).all()
    assert np.array_equal(after, sharding.even(items, before, 24))
    one = np.array([[5, 5, 1]])
    assert sharding.even(one, sharding.pack(one, 24), 24).shape == (1,) and sharding.even(one[:0], sharding.pack(one[:0], 24), 24).shape == (0,)


def test_sharding_is_even_in_bytes_tokens_and_rows(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(docs, scratch).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    by = got.groupby("shard").agg(b=("size", "sum"), t=("tokens", "sum"), r=("size", "count"))
    assert len(by) == 24 and ((by.max() - by.min()) / by.mean() < 0.03).all()
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])
