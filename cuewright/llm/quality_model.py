"""Quality classifier: Naive Bayes support vectors.

Indicators of byte n-grams and of n-grams of word shapes are scaled by the log
ratio of their class counts, and a linear hinge-loss model over them is fitted
by dual coordinate descent; margins become probabilities by a logistic curve
fitted on rows that the weights have not seen.

Class counts and the fit take at most ``SAMPLE`` labelled rows of each class outside
the held-out fold (those of least hash of the id), a bound that does not grow with the data;
the share of the classes comes from all labelled rows.  Labels and ids alone are joined, and
the sample's ids are broadcast, so no text is shuffled but the sample's.  Scoring reads each
whole text where it lies.

Defined results: a null text is scored as an empty one; rows without a label
or with a null id are scored all the same; if only one class, or none, is
labelled, all scores are its share (0.5 for none); repeated rows are alike, and of texts under one
labelled id one is learned from; a text of any length is read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .shared import Scratch
from .textkit import NOT_SPACE, blocks, mix

SIZE = 1 << 16
#: The bound on labelled rows of each class that a fit takes.
SAMPLE = 3000
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True


def features(texts: pa.Array):
    """For each text, the sorted distinct indices of its indicators."""
    seen = np.zeros(SIZE, dtype=bool)
    for b in blocks(texts):
        d = b.data.astype(np.uint64)
        two = (mix((d[:-1] << np.uint64(8)) | d[1:]) & np.uint64(SIZE - 1)).astype(np.int64) if len(d) > 1 else np.zeros(0, np.int64)
        three = (mix((np.uint64(1) << np.uint64(32)) | (d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]) & np.uint64(SIZE - 1)).astype(np.int64) if len(d) > 2 else np.zeros(0, np.int64)
        s, e, first = b.spans(NOT_SPACE)
        h = b.hashes(s, e)
        sums = [np.concatenate([[0], np.cumsum(m[b.data])]) for m in (_UPPER, _LETTER, _DIGIT, _STOP)]
        upper, letters, digits, stops = (x[e] - x[s] for x in sums)
        n = e - s
        same = np.zeros(len(h), dtype=bool)
        same[1:] = h[1:] == h[:-1]
        shape = (upper > 1).astype(np.uint64) | ((upper == 1).astype(np.uint64) << np.uint64(1)) | ((letters == 0).astype(np.uint64) << np.uint64(2)) | ((digits > 0).astype(np.uint64) << np.uint64(3)) | ((stops > 0).astype(np.uint64) << np.uint64(4)) | ((n - letters - digits - stops > 0).astype(np.uint64) << np.uint64(5)) | (same.astype(np.uint64) << np.uint64(6)) | (np.minimum(n // 4, 4).astype(np.uint64) << np.uint64(7))
        one = (mix(shape | np.uint64(1 << 40)) & np.uint64(SIZE - 1)).astype(np.int64)
        tri = (mix((shape[:-2] << np.uint64(20)) | (shape[1:-1] << np.uint64(10)) | shape[2:] | np.uint64(1 << 41)) & np.uint64(SIZE - 1)).astype(np.int64) if len(shape) > 2 else np.zeros(0, np.int64)
        at = b.offsets
        for i in range(b.rows):
            lo, hi, w0, w1 = at[i], at[i + 1], first[i], first[i + 1]
            seen[two[lo : max(lo, hi - 1)]] = True
            seen[three[lo : max(lo, hi - 2)]] = True
            seen[one[w0:w1]] = True
            seen[tri[w0 : max(w0, w1 - 2)]] = True
            idx = np.flatnonzero(seen)
            seen[idx] = False
            yield idx


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id: str, text: str, label: str):
    """(weights, bias, slope, offset)."""
    sample, n = linear.labelled_sample(docs, labels, scratch, id=id, text=text, label=label, folds=FOLDS, fold=FOLD, each=SAMPLE)
    if min(n) == 0:
        share = 0.5 if sum(n) == 0 else (0.99 if n[1] else 0.01)
        return np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share)))
    x, y01, _ = linear.sample_rows(sample, features)
    seen = np.array([(y01 == k).sum() for k in (0, 1)])
    p = (linear.indicator_counts(x, y01, SIZE) + 1.0) / (seen[:, None] + 2.0)
    ratio = np.log(p[1] / p[0])
    y = np.where(y01 == 1, 1.0, -1.0)
    # The last index is a constant, the bias.
    scale = np.append(ratio, 1.0)
    lists = [np.append(x.row(i), SIZE) for i in range(len(x))]
    spare = np.arange(len(y)) % 4 == 3
    fitted = linear.Rows([v for v, t in zip(lists, spare, strict=True) if not t])
    norm = max(float(np.mean(fitted.dot(scale * scale))), 1e-9)
    scale = scale / np.sqrt(norm)
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    w = linear.dual_coordinate_descent(fitted, y[~spare], scale, cost=2.0, weight=weight[~spare]) * scale
    margin = linear.Rows([v for v, t in zip(lists, spare, strict=True) if t]).dot(w)
    slope, offset = linear.calibrate(margin, y[spare])
    m1, m0 = max((y[spare] > 0).sum(), 1), max((y[spare] < 0).sum(), 1)
    offset += float(np.log((n[1] / n[0]) / (m1 / m0)))
    return w[:-1], float(w[-1]), slope, offset


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """For each document: id, held_out, score, predicted."""
    w, bias, slope, offset = fit(docs, labels, scratch, id=id, text=text, label=label)
    out = docs.select(F.col(id).alias(id), linear.held_out(id, FOLDS, FOLD).alias("held_out"), linear.score_column(F.col(text), features, w, bias, slope, offset).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
