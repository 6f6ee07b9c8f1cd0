"""Sparse linear classifiers on hashed indicators, for the fits on bounded samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .textkit import each_batch


def held_out(id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, leaves ``fold`` modulo ``folds``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id: str, text: str, label: str, folds: int, fold: int, each: int) -> tuple[DataFrame, tuple[int, int]]:
    """At most ``each`` labelled rows (id, text, label) of each label that may be learned from, and how many there are of each label.

    Ids and labels alone are joined and counted, over all rows; the sample is the ids of least hash.
    It is bounded by ``each``, so it is broadcast and its texts are read where they lie.  Of texts under
    one id the one of least hash is taken; labels that disagree count as 1.
    """
    y = labels.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label")).where("label in (0, 1)").where(~held_out("id", folds, fold)).groupBy("id").agg(F.max("label").cast("int").alias("label"))
    have = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"))
    known = scratch.save(y.join(have, "id", "left_semi"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(each) for k in (0, 1)]
    chosen = scratch.save(parts[0].unionByName(parts[1]))
    x = docs.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = x.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    return scratch.save(rows), (counts.get(0, 0), counts.get(1, 0))


class Rows:
    """Sparse rows as one index array and offsets; all values are one before scaling."""

    def __init__(self, lists: list[np.ndarray]):
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.index = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.at) - 1

    def row(self, i: int) -> np.ndarray:
        return self.index[self.at[i] : self.at[i + 1]]

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=np.repeat(g, np.diff(self.at)), minlength=size)


def dual_coordinate_descent(x: Rows, y: np.ndarray, scale: np.ndarray, cost: float = 1.0, passes: int = 30, weight: np.ndarray | None = None, seed: int = 5) -> np.ndarray:
    """Weights of the linear hinge-loss model over scaled indicators; y is -1 or 1.

    One dual variable for each row moves to its optimum in [0, cost * weight] while the
    others stay, in a seeded random order, until a pass changes little.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(len(scale))
    alpha = np.zeros(len(y))
    top = cost * (weight if weight is not None else np.ones(len(y)))
    norm = x.dot(scale * scale)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(y)):
            if norm[i] == 0:
                continue
            idx = x.row(i)
            v = scale[idx]
            g = y[i] * float(w[idx] @ v) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), top[i])
            step = new - alpha[i]
            if abs(step) > 1e-9:
                w[idx] += step * y[i] * v
                alpha[i] = new
                most = max(most, abs(step) / top[i])
        if most < 0.01:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins (Platt, with smoothed targets), by Newton steps that are halved until the loss falls."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(at: np.ndarray) -> float:
        z = at[0] * margin + at[1]
        return float((np.logaddexp(0, z) - t * z).sum())

    at = np.array([1.0, math.log((n1 + 1) / (n0 + 1))])
    now = loss(at)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margin + at[1], -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        while np.abs(step).max() >= 1e-8 and (later := loss(at - step)) >= now:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        at, now = at - step, later
    return float(max(at[0], 1e-6)), float(at[1])


def indicator_counts(x: Rows, y: np.ndarray, size: int) -> np.ndarray:
    """How many of the sample's rows of each label have each feature: an array of shape (2, size)."""
    label = np.repeat(y, np.diff(x.at)).astype(np.int64)
    return np.bincount(label * size + x.index, minlength=2 * size).reshape(2, size)


def sample_rows(sample: DataFrame, features) -> tuple[Rows, np.ndarray, np.ndarray]:
    """The sample's features, labels and ids, made on the executors."""

    def make(batches):
        def rows(b):
            lists = [x.astype(np.int32) for x in features(b.column(1))]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lists, type=pa.list_(pa.int32()))], names=["id", "label", "f"])

        yield from each_batch(rows, batches)

    got = sample.select("id", "text", "label").mapInArrow(make, "id bigint, label int, f array<int>").toArrow().combine_chunks()
    got = got.take(pa.array(np.argsort(got.column("id").to_numpy(), kind="stable"))).combine_chunks()
    f = got.column("f").combine_chunks() if isinstance(got.column("f"), pa.ChunkedArray) else got.column("f")
    f = f.chunk(0) if isinstance(f, pa.ChunkedArray) else f
    rows = Rows([])
    rows.at = f.offsets.to_numpy().astype(np.int64) if len(f) else np.zeros(1, np.int64)
    rows.index = f.values.to_numpy()[: rows.at[-1]] if len(f) else np.zeros(0, np.int32)
    return rows, got.column("label").to_numpy(), got.column("id").to_numpy()


def score_column(text: Column, features, w: np.ndarray, bias: float, slope: float, offset: float) -> Column:
    """The calibrated score of each whole text; a null text counts as empty."""
    small = w.astype(np.float32)

    def scores(texts: pa.Array) -> pa.Array:
        m = np.array([float(small[idx].sum()) for idx in features(texts)], dtype=np.float64) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30))))

    @F.arrow_udf("double")
    def linear_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_batch(scores, batches)

    return linear_score(text)
