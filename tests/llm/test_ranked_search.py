"""The k best documents of each item against scoring every document."""

import math
import random
import re
from collections import Counter

import helpers
import pytest

from cuewright.llm import ranked_search as R
from cuewright.llm import shared

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, extra string"


def terms(text):
    return TERM.findall((text or "").translate(helpers.LOWER))


def brute(rows, items, k):
    tfs = [(r[0], Counter(terms(r[1]))) for r in rows]
    tfs = [(d, c) for d, c in tfs if c]
    count, total = len(tfs), sum(c.total() for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    wanted = {}
    for i, text, *_ in items:
        wanted.setdefault(i, set()).update(terms(text))
    out = []
    for i, own in wanted.items():
        scores = []
        for d, c in tfs:
            m = 100 - 50 + (50 * c.total() * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, rank + 1, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def tables(n, seed=2):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choice(common) if rnd.random() < 0.7 else f"R{rnd.randrange(900)}" for _ in range(rnd.randrange(1, 60))), "en", "s", 1) for i in range(n)]
    rows += [(n + i, "c1 c2 R3, c1!", "en", "s", 1) for i in range(n // 2)]  # a stratum that holds a third, all scores equal
    rows += [(5, "again C3 r4", None, None, 1), (5, "again C3 r4", None, None, 1), (None, "c5 r6 é", None, None, 1), (9999, None, None, None, None), (9998, " .,;", "en", "s", 4), (9997, "c7 " * 20_000 + "r8", "en", "s", 1)]
    items = [(i, " ".join(rnd.choice(common + [f"r{rnd.randrange(900)}" for _ in range(20)]) for _ in range(rnd.randrange(1, 12))), None) for i in range(25)]
    items += [(100, None, "x"), (101, "", "x"), (102, "unknown words", "x"), (103, "C1 c1 é É", "x"), (7, "c9 R10", "x"), (None, "r3 c2", "x")]
    return rows, items


@pytest.mark.parametrize("k,shelf,block,small", [(5, 16, 4, None), (50, 2048, 256, None), (3, 7, 10, 0)])
def test_ranks_equal_scoring_everything(spark, scratch, monkeypatch, k, shelf, block, small):
    monkeypatch.setattr(R, "SHELF_DOCS", shelf)
    monkeypatch.setattr(R, "ITEM_BLOCK", block)
    if small is not None:
        monkeypatch.setattr(shared, "SMALL_BYTES", small)
    rows, items = tables(120)
    out = R.search(helpers.frame(spark, rows, clash=True), spark.createDataFrame(items, ITEMS).repartition(2), scratch, k)
    assert got(out) == brute(rows, items, k)


def test_postings_bound_of_a_shelf(spark, scratch, monkeypatch):
    monkeypatch.setattr(R, "SHELF_POSTINGS", 40)
    rows, items = tables(60, 4)
    assert got(R.search(helpers.frame(spark, rows), spark.createDataFrame(items, ITEMS), scratch, 5)) == brute(rows, items, 5)


def test_empty_tables(spark, scratch):
    rows, items = tables(10)
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame(items, ITEMS)
    assert got(R.search(helpers.empty(spark), some, scratch)) == []
    assert got(R.search(helpers.frame(spark, [(1, None, None, None, None)]), some, scratch)) == []
    assert got(R.search(helpers.frame(spark, rows), none, scratch)) == []
