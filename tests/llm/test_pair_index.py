"""Ids and decoded texts against the library, and merging against one word at a time."""

import random
from hashlib import sha256

import helpers
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cuewright.llm import pair_index as P
from cuewright.llm import registry
from cuewright.llm.bpe import read_model

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return P.WordVocabulary(read_model(PATH))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(encoder, texts):
    ids, at = encoder.block(texts)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def one_word(v, word):
    """Least rank first, leftmost first, within one word."""
    raw = word.encode()
    sym = [int(v.inner[b]) for b in raw[:-1]] + [int(v.last[raw[-1]])]
    while True:
        best = min(((v.ranks[a << P.SHIFT | b], i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if a << P.SHIFT | b in v.ranks), default=None)
        if best is None:
            return tuple(sym)
        sym[best[1] : best[1] + 2] = [v.merges[best[0]][2]]


def test_index_equals_merging_word_by_word(vocabulary):
    rnd = random.Random(3)
    words = ["".join(rnd.choice(["a", "aa", "th", "e", "in", "ing", "é", "ß", "#", "t", "漢"]) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]
    words = list(dict.fromkeys([*words, "a", "aaaaaaa", "thethethe", "banana"]))
    index = P.PairIndex(vocabulary, words)
    index.merge()
    assert not index.places
    assert index.codes() == [one_word(vocabulary, w) for w in words]


@pytest.mark.parametrize("many", [1, 3, 10**9])
def test_many_positions_at_once_equal_one_by_one(vocabulary, monkeypatch, many):
    monkeypatch.setattr(P, "MANY", many)
    rnd = random.Random(7)
    words = ["".join(rnd.choice(["a", "aa", "aaa", "o", "oo", "lol", "!", "!!!", "th", "e", "in", "é", "漢"]) for _ in range(rnd.randrange(1, 14))) for _ in range(500)]
    words = list(dict.fromkeys([*words, *("a" * n for n in range(1, 40)), *("!" * n for n in range(1, 40)), "hahahahaha", "banana"]))
    index = P.PairIndex(vocabulary, words)
    index.merge()
    assert not index.places
    assert index.codes() == [one_word(vocabulary, w) for w in words]
    none = P.PairIndex(vocabulary, [])
    none.merge()
    assert none.codes() == []


def test_most_positions_are_merged_in_bulk(vocabulary, monkeypatch):
    rnd = random.Random(8)
    index = P.PairIndex(vocabulary, ["".join(rnd.choice(["th", "e", "in", "er", "an", "ou", "s", "t"]) for _ in range(4)) + str(k) for k in range(20_000)])
    one_by_one, few = [], P.PairIndex.at_few
    monkeypatch.setattr(P.PairIndex, "at_few", lambda self, here, *rest: (one_by_one.append(len(here)), few(self, here, *rest)))
    index.merge()
    merged = int((index.sym == P.DEAD).sum())
    assert sum(one_by_one) < merged / 3


def test_every_character_as_the_library(vocabulary, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"{c}a{c}{c}1" for c in chars[k : k + 2000]) for k in range(0, len(chars), 2000)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(P.WordEncoder(vocabulary), texts) == want


def test_odd_texts_as_the_library(vocabulary, library):
    texts = ["", " \n\t", "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>c", "<|endoftext", "<|ENDOFTEXT|>", "ΣΑΣ σας Σ", "İstanbul ǅ", "é é É<|endoftext|>́x", "it's I'LL 'twas''s", "x" * 5000, "12３½²", "a\u0085b c d​e", "\x00\x01"]
    for t in texts:
        got = ids_of(P.WordEncoder(vocabulary), [t])[0]
        e = library.encode(t, add_special_tokens=False)
        assert got == e.ids, t
        assert decoded(vocabulary, [got]) == [library.decode(e.ids, skip_special_tokens=False)]


def decoded(vocabulary, lists):
    import pyarrow as pa

    return P.decode_lists(vocabulary, pa.array(lists, pa.list_(pa.int32()))).to_pylist()


def test_decoding_of_nulls_and_unknown_ids(vocabulary, library):
    lists = [None, [], [0, 10**6, 49407], [5], [-1], None, [7, None, 9]]
    want = [None if x is None else library.decode([i for i in x if i is not None and i >= 0], skip_special_tokens=False) for x in lists]
    assert decoded(vocabulary, lists) == want
    import pyarrow as pa

    part = pa.array([[1, 2], *lists], pa.list_(pa.int32())).slice(3, 3)
    assert P.decode_lists(vocabulary, part).to_pylist() == want[2:5]


def test_random_texts_with_a_small_table(vocabulary, library, monkeypatch):
    monkeypatch.setattr(P, "KEPT_WORDS", 7)
    rnd = random.Random(5)
    encoder = P.WordEncoder(vocabulary)
    for _ in range(60):
        texts = ["".join(rnd.choice("ab eE'sé́\n1<|>!Ωσ") for _ in range(rnd.randrange(60))) for _ in range(5)]
        assert ids_of(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_long_word_is_merged_in_proportion(vocabulary, library):
    word = "banana" * 30_000
    assert ids_of(P.WordEncoder(vocabulary), [word])[0] == library.encode(word, add_special_tokens=False).ids


def test_columns(spark, scratch, library):
    data = read_model(PATH)
    rows = helpers.corpus() + [(900, "<|endoftext|>A", "en", None, 1)] * 2
    df = helpers.frame(spark, rows, clash=True).withColumn("ids", P.encode(F.col("text"), data)).withColumn("back", P.decode(F.col("ids"), data))
    for r in df.collect():
        want = None if r.text is None else library.encode(r.text, add_special_tokens=False).ids
        assert (None if r.ids is None else list(r.ids)) == want
        assert r.back == (None if want is None else library.decode(want, skip_special_tokens=False))
    assert helpers.empty(spark).select(P.encode(F.col("text"), data)).collect() == []


def test_query_as_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in registry.table(spark, sf, "documents").collect()}
    got = registry.op12_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(text)
    digest = lambda s: sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_one_pass_of_each_kind(spark):
    plan = registry.op12_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("encode_words(") == 1 and plan.count("decode_words(") == 1
