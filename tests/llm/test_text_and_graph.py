"""Block-wise text primitives and components against plain Python."""

import random

import numpy as np
import pyarrow as pa
from helpers import WORD, corpus
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm import textkit as T
from cuewright.llm.shared import components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é🙂\n\t#", max_size=40)), max_size=12), st.integers(1, 30))
def test_words_of_blocks(texts, size):
    got = []
    for b in T.blocks(pa.array(texts, type=pa.string()), size):
        s, e, first = b.spans(T.NOT_SPACE)
        got += [[bytes(b.data[s[k] : e[k]]).decode() for k in range(first[i], first[i + 1])] for i in range(b.rows)]
    assert got == [WORD.findall(t or "") for t in texts]


def test_hashes_and_grams_stand_for_content():
    texts = [r[1] for r in corpus()]
    for k in (3, 5):
        by = {}
        for size in (64, 1 << 20):
            for b in T.blocks(pa.array(texts, type=pa.string()), size):
                s, e, first = b.spans(T.NOT_SPACE)
                g, g_first = T.grams(b.hashes(s, e), first, k)
                for i in range(b.rows):
                    w = [bytes(b.data[s[j] : e[j]]).decode() for j in range(first[i], first[i + 1])]
                    own = [tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
                    assert len(own) == g_first[i + 1] - g_first[i]
                    for x, h in zip(own, g[g_first[i] :]):
                        assert by.setdefault(x, h) == h
        assert len(set(map(int, by.values()))) == len(by)


def test_slices_of_arrow_columns():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1, 3)
    assert [b.spans(T.NOT_SPACE)[2].tolist() for b in T.blocks(column)] == [[0, 0, 1, 4]]
    assert list(T.blocks(pa.array([], type=pa.string()))) == []


def test_components(spark, scratch):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, k) for k in range(501, 560)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]} | {i: find(i) for i in got}
    assert components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


def test_lists():
    assert T.lists(np.arange(6), 2).to_pylist() == [[0, 1], [2, 3], [4, 5]]
