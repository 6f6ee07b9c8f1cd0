"""Small tables with nulls, empty and long texts, repeated rows and clashing columns; brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns, named like what operators use inside.
CLASH = "id long, kept boolean, n int, key string, rep long, h1 long, lang1 string"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages and odd texts."""
    rnd = random.Random(seed)
    passage = words(rnd, 70, 10_000)
    rows, i = [], 0
    for _ in range(n):
        w = words(rnd, rnd.randrange(30, 160), 5_000)
        kind = rnd.randrange(6)
        if kind == 0:
            at = rnd.randrange(len(w))
            w[at:at] = passage
        rows.append((i, " ".join(w)))
        i += 1
        if kind == 1:
            rows.append((i, rows[-1][1]))
            i += 1
        if kind == 2:
            for _ in range(3):
                v = list(w)
                v[rnd.randrange(len(v))] = f"x{i}"
                rows.append((i, " ".join(v)))
                i += 1
    odd = [None, "", " \t\n ", "one", "one", "One two THREE", "é É ß", "word " * 300, "\u0000 a b", "a " * 3 + "\n\n" + "b"]
    rows += [(i + k, t) for k, t in enumerate(odd)]
    langs, sources = ("en", "fr", None), ("s0", "s0", "s1", None)
    return [(d, t, langs[d % 3], sources[d % 4], None if t is None else len(t)) for d, t in rows]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for part in CLASH.split(", "):
            name, kind = part.split(" ")
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, percent=85):
    """The smallest id that each id reaches, from all pairs."""
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def repeated(rows, k=50):
    """Words of each document in windows that other documents have, and in windows that earlier ones have."""
    w = {r[0]: WORD.findall(r[1] or "") for r in rows if r[0] is not None}
    seen = defaultdict(set)
    for i, x in w.items():
        for p in range(len(x) - k + 1):
            seen[tuple(x[p : p + k])].add(i)
    both = {}
    for i, x in w.items():
        a, b = set(), set()
        for p in range(len(x) - k + 1):
            who = seen[tuple(x[p : p + k])]
            if len(who) > 1:
                a |= set(range(p, p + k))
            if min(who) < i:
                b |= set(range(p, p + k))
        if a:
            both[i] = a, b
    return both


def base_metrics(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
