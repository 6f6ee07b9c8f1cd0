"""Toxicity: a counterfactual-regularised classifier.

A logistic model over indicators of words, word pairs and word beginnings, the
latter with how often they occur (inflected words share a beginning).  Every sample text that has a
swap term is paired with copies in which each such term is swapped for the
others of its set in turn, and the squared change of the score, averaged over these copies, is
penalised, so that the mention of a group by itself does not move a score.

Swap sets are the given identity terms and sets mined from the sample: frequent words that say
little about the label by themselves and that stand in the same contexts (:func:`mined_sets`).

The indicators are chosen (log odds at least ``SIGNIFICANT`` standard errors from zero) and
fitted on at most ``SAMPLE`` labelled rows of each class outside the held-out fold, those of least
hash of the id; the share of the classes comes from all labelled rows.  Labels and ids alone
are joined, so no text is shuffled but the sample's.  Scoring reads each whole text where it lies.

Defined results: a null text is scored as an empty one; rows without a label
or with a null id are scored all the same; if only one class, or none, is
labelled, all scores are near its share (0.5 for none); repeated rows
are alike, and of texts under one labelled id one is learned from; a text of any length is read whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .decontaminate import words as words_of
from .shared import Scratch
from .textkit import Block, blocks, mix

SIZE = 1 << 18
#: The bound on labelled rows of each class that a fit takes.
SAMPLE = 4000
FOLDS, FOLD = 5, 0
THRESHOLD = 0.5
SIGNIFICANT = 3.0
PENALTY = 1.0
RIDGE = 1e-4

#: Words of one row can stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("young", "old", "elderly"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("frauen", "männer"),
)

#: Bytes of a word: ASCII letters and digits, and everything beyond ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def word_hash(words) -> np.ndarray:
    """The hash that texts' words get, for single words."""
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        b = Block(raw, np.array([0, len(raw)]))
        out.append(b.hashes(np.array([0]), np.array([len(raw)]), lower=True)[0])
    return np.array(out, dtype=np.uint64)


def swaps(sets=IDENTITY_TERMS, turn: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of swap terms, sorted, and of the term that stands in for each at a turn, counted from 1."""
    pairs = [(a, row[(i + 1 + (turn - 1) % (len(row) - 1)) % len(row)]) for row in sets for i, a in enumerate(row)]
    a, b = word_hash(x for x, _ in pairs), word_hash(x for _, x in pairs)
    order = np.argsort(a)
    return a[order], b[order]


#: What mining takes: so many frequent words, as terms and as contexts; how alike the contexts of a set's words are; and a set's size.
MINED, ALIKE, LARGEST = 200, 0.6, 6


def mined_sets(sample: DataFrame, known=IDENTITY_TERMS, *, most: int = MINED, alike: float = ALIKE, largest: int = LARGEST) -> tuple[tuple[str, ...], ...]:
    """Sets of frequent words of the sample (id, text, label) that say little by themselves and stand in the same contexts.

    Counting and contexts are Spark aggregations; at most ``most`` words and their counts beside one another are collected.
    """
    w = sample.select("label", words_of(F.col("text")).alias("w"))
    n1, n0 = (w.where(F.col("label") == k).count() for k in (1, 0))
    taken = [x for row in known for x in row]
    seen = w.select("label", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("n") - F.col("a") + 0.5) / (n0 - F.col("n") + F.col("a") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    plain = seen.where((F.col("n") * 100 >= n1 + n0) & (F.abs(odds) < error) & ~F.col("word").isin(taken))
    names = [r.word for r in plain.orderBy(F.desc("n"), "word").limit(most).collect()]
    if len(names) < 2:
        return ()
    chosen = F.array(*map(F.lit, names))
    pair = F.expr("transform(sequence(1, size(w) - 1), i -> struct(w[i - 1] as l, w[i] as r))")
    beside = w.where(F.size("w") > 1).select(F.explode(pair).alias("p")).select("p.*").where(F.array_contains(chosen, F.col("l")) & F.array_contains(chosen, F.col("r")))
    at = {x: i for i, x in enumerate(names)}
    context = np.zeros((len(names), 2 * len(names)))
    for r in beside.groupBy("l", "r").count().collect():  # bounded by most * most
        context[at[r.l], at[r.r]] += r["count"]
        context[at[r.r], len(names) + at[r.l]] += r["count"]
    context = np.sqrt(context)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    near = context @ context.T
    free, sets = set(range(len(names))), []
    for i in range(len(names)):
        if i in free:
            row = [i, *[j for j in np.argsort(-near[i], kind="stable").tolist() if j != i and j in free and near[i, j] >= alike][: largest - 1]]
            if len(row) > 1:
                sets.append(tuple(names[j] for j in row))
                free -= set(row)
    return tuple(sets)


#: Bytes of a word's beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)


def _indices(h: np.ndarray, beginnings: np.ndarray) -> np.ndarray:
    """Distinct indices of one text's words, word pairs, and beginnings that occur once, twice, three times or more."""
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    u, n = np.unique(beginnings, return_counts=True)
    levels = [mix(u[n >= k] + np.uint64(k)) for k in (1, 2, 3)]
    return np.unique((np.concatenate([h, pair, *levels]) & np.uint64(SIZE - 1)).astype(np.int64))


def features_of(sets=IDENTITY_TERMS, turn: int = 0):
    """A function that gives, for each text, the sorted distinct indices of its indicators, after the swap of a turn (0: none)."""
    terms, other = swaps(sets, max(turn, 1))

    def features(texts: pa.Array):
        for b in blocks(texts):
            s, e, first = b.spans(_WORD)
            h = b.hashes(s, e, lower=True)
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            term = terms[at] == h
            if turn:
                h = np.where(term, other[at], h)
            # A swap term has no beginnings, so that all terms look alike there.
            word, starts = [], []
            for k in BEGINNINGS:
                long = np.flatnonzero((e - s >= k) & ~term)
                word.append(long)
                starts.append(b.hashes(s[long], s[long] + k, lower=True) ^ np.uint64(k << 8))
            word, starts = np.concatenate(word), np.concatenate(starts)
            order = np.argsort(word, kind="stable")
            word, starts = word[order], starts[order]
            cuts = np.searchsorted(word, first)
            for i in range(b.rows):
                yield _indices(h[first[i] : first[i + 1]], starts[cuts[i] : cuts[i + 1]])

    return features


def chosen_features(mask: np.ndarray, base):
    def chosen(texts: pa.Array):
        for idx in base(texts):
            yield idx[mask[idx]]

    return chosen


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id: str, text: str, label: str, sets=IDENTITY_TERMS, mine: bool = True, penalty: float = PENALTY):
    """(weights, bias, slope, offset, swap sets, effect): effect is what :func:`swap_effect` says of the rows held back from the weights."""
    sample, n = linear.labelled_sample(docs, labels, scratch, id=id, text=text, label=label, folds=FOLDS, fold=FOLD, each=SAMPLE)
    if min(n) == 0:
        share = 0.5 if sum(n) == 0 else (0.99 if n[1] else 0.01)
        return np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))), sets, (0.0, 0.0)
    if mine:
        sets = (*sets, *mined_sets(sample, sets))
    x, y, _ = linear.sample_rows(sample, features_of(sets))
    counts = linear.indicator_counts(x, y, SIZE)
    seen = np.array([float((y == k).sum()) for k in (0, 1)])
    c = counts + 0.5
    odds = np.log(c[1] / (seen[1] - c[1] + 1)) - np.log(c[0] / (seen[0] - c[0] + 1))
    error = np.sqrt(1 / c[1] + 1 / c[0])
    mask = (np.abs(odds) >= SIGNIFICANT * error) & (counts.sum(axis=0) >= 3)
    terms = np.unique((np.concatenate(swaps(sets)) & np.uint64(SIZE - 1)).astype(np.int64))
    mask[terms] |= counts.sum(axis=0)[terms] > 0
    turns = range(max(map(len, sets))) if sets else range(1)  # 0 is the text itself
    rows = [linear.sample_rows(sample, chosen_features(mask, features_of(sets, k)))[0] for k in turns]
    spare = np.arange(len(y)) % 4 == 3
    part = lambda r, t: linear.Rows([r.row(i) for i in np.flatnonzero(t)])
    w, bias = descend(part(rows[0], ~spare), [part(z, ~spare) for z in rows[1:]], y[~spare].astype(float), penalty=penalty)
    held = part(rows[0], spare)
    margin = held.dot(w) + bias
    slope, offset = linear.calibrate(margin, np.where(y[spare] == 1, 1, -1))
    m1, m0 = max((y[spare] == 1).sum(), 1), max((y[spare] == 0).sum(), 1)
    effect = swap_effect(held, [part(z, spare) for z in rows[1:]], w, bias)
    return w, bias, slope, offset + float(np.log((n[1] / n[0]) / (m1 / m0))), sets, effect


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def swap_effect(x: linear.Rows, swapped: list[linear.Rows], w: np.ndarray, bias: float) -> tuple[float, float]:
    """The share of rows that a swap changes, and the mean change of their scores."""
    p = _chance(x.dot(w) + bias)
    changed = [np.array([not np.array_equal(x.row(i), z.row(i)) for i in range(len(x))], dtype=bool) for z in swapped]
    moved = [np.abs(_chance(z.dot(w) + bias) - p)[c] for z, c in zip(swapped, changed, strict=True)]
    every = np.concatenate(moved) if moved else np.zeros(0)
    return float(np.any(changed, axis=0).mean()) if changed and len(x) else 0.0, float(every.mean()) if len(every) else 0.0


def descend(x: linear.Rows, swapped: list[linear.Rows], y: np.ndarray, steps: int = 300, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise logistic loss + penalty * (score - swapped score)**2, averaged over swaps, + RIDGE, by accelerated descent.

    Scores are penalised before the logistic curve, so that changes count on rows that are sure of their label too.
    """
    w, v, bias, vb = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))) / len(y)
    rate = 0.5
    # Steps are divided, for each weight, by the curvature that the penalty gives it at most.
    bend = np.ones(SIZE)
    for z in swapped:
        moved = [np.setxor1d(x.row(i), z.row(i), assume_unique=True) for i in range(len(x))]
        bend += 2 * rate * penalty / len(swapped) * linear.Rows(moved).back(weight * np.array([len(m) for m in moved]), SIZE)
    for t in range(steps):
        beta = t / (t + 3)
        u, ub = w + beta * v, bias + beta * vb
        m = x.dot(u)
        gx = weight * (_chance(m + ub) - y)
        gb = float(gx.sum())
        grad = 2 * RIDGE * u
        for z in swapped:
            d = 2 * penalty / len(swapped) * weight * (m - z.dot(u))
            gx = gx + d
            grad -= z.back(d, SIZE)
        grad += x.back(gx, SIZE)
        new = u - rate * grad / bend
        nb = ub - rate * gb
        v, vb = new - w, nb - bias
        w, bias = new, nb
    return w, float(bias)


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", label: str = "toxic", sets=IDENTITY_TERMS, mine: bool = True) -> DataFrame:
    """For each document: id, held_out, score, predicted."""
    w, bias, slope, offset, sets, _ = fit(docs, labels, scratch, id=id, text=text, label=label, sets=sets, mine=mine)
    out = docs.select(F.col(id).alias(id), linear.held_out(id, FOLDS, FOLD).alias("held_out"), linear.score_column(F.col(text), features_of(sets), w, bias, slope, offset).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
