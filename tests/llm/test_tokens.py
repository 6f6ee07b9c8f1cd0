import pytest
from helpers import corpus, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuewright.llm import bpe, registry

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = bpe.read_model(registry.model_path())
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
VOCABULARY = bpe.vocabulary_of(MODEL)
TEXT = st.one_of(st.text(max_size=60), st.text(alphabet="ab ▁\n\té🙂.<s>0", max_size=60))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.Counter(VOCABULARY).count(text) == len(LIBRARY.encode(text))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_encoding_is_lossless(text):
    text = text.encode("utf-8", "ignore").decode()
    for dropout in (0.0, 0.3, 1.0):
        assert bpe.decode_ids(VOCABULARY, bpe.Encoder(VOCABULARY, dropout, 7).encode(text)) == text
    if "▁" not in text:
        assert list(bpe.Encoder(VOCABULARY).encode(text)) == LIBRARY.encode(text)


def test_dropout_varies_with_document_and_place():
    encoder = bpe.Encoder(VOCABULARY, 0.1, 0)
    docs = [encoder.encode(" ".join(["international"] * 300), key) for key in range(40)]
    assert len({tuple(x) for x in docs}) == 40
    assert docs[3] == bpe.Encoder(VOCABULARY, 0.1, 0).encode(" ".join(["international"] * 300), 3)
    for ids in docs:
        cut, whole = [], LIBRARY.encode("international")
        for i in ids:
            if VOCABULARY.bytes[i].startswith(b" "):
                cut.append([])
            cut[-1].append(i)
        assert len(cut) == 300 and len({tuple(x) for x in cut}) > 5 and 0 < cut.count(whole) < 300


def test_candidates_are_skipped_at_the_rate():
    encoder = bpe.Encoder(VOCABULARY, 0.1, 5)
    own = bpe.mixed(17)
    hits = [0] * 6
    for place, first in enumerate(encoder.first_skips(own, 20_000)):
        for x in encoder.skips(own, place, first):
            if x > 5:
                break
            hits[x] += 1
    assert all(abs(x / 20_000 - 0.1) < 0.01 for x in hits)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeinorst ▁\né", max_size=90), st.integers(-5, 2**62))
def test_tables_give_what_merging_anew_gives(text, key):
    for dropout in (0.1, 0.5):
        kept = bpe.Encoder(VOCABULARY, dropout, 3)
        fresh = bpe.Encoder(VOCABULARY, dropout, 3)
        bound, bpe.KEPT_PART = bpe.KEPT_PART, 0
        try:
            want = fresh.encode(text, key)
        finally:
            bpe.KEPT_PART = bound
        assert kept.encode(text, key) == want == kept.encode(text, key)


def test_full_tables_change_nothing():
    table = bpe.Table(lambda k: k * 2, 3)
    assert [table[k] for k in (1, 2, 3, 4, 1, 5, 6, 7, 1)] == [2, 4, 6, 8, 2, 10, 12, 14, 2]
    assert len(table) <= 3 and len(table.old) <= 3


def test_columns(spark, scratch):
    rows = corpus()
    df = frame(spark, rows, clash=True)
    counted = {r.doc_id: r.n for r in df.select("doc_id", bpe.token_counts(F.col("text"), MODEL).alias("n")).collect()}
    assert counted == {r[0]: len(LIBRARY.encode(r[1] or "")) for r in rows}
    code = lambda seed: {r.doc_id: r for r in registry.encoded(spark, df, seed=seed).collect()}
    a, again, b = code(0), code(0), code(1)
    assert {k: r.token_ids for k, r in a.items()} == {k: r.token_ids for k, r in again.items()}
    assert sum(a[k].token_ids != b[k].token_ids for k in a) > len(rows) / 2
    for i, t, *_ in rows:
        assert a[i].lossless is (None if t is None else True)
        assert (a[i].token_ids is None) == (t is None)
        assert t is None or a[i].n_tokens >= len(LIBRARY.encode(t)) and a[i].n_tokens == len(a[i].token_ids)
    back = registry.encoded(spark, df).select("doc_id", bpe.decode(F.col("token_ids"), MODEL).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {r[0]: r[1] for r in rows}
    assert registry.encoded(spark, empty(spark)).count() == 0
