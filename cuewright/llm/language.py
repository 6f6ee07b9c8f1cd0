"""Language identification by rank-order profiles.

Each language's profile is the list of its ``PROFILE`` most frequent n-grams
of characters (one to three code points, lower-cased by Unicode, words bounded by a blank; whatever is no
letter is a blank).  A document's own most frequent n-grams are
compared with every profile by out-of-place distance: the sum of rank
differences, with the greatest for n-grams that a profile lacks.

Profiles count the whole texts of all training documents: each task sums its own
counts, these are summed by key, and the first ranks are taken for each
language.  What reaches the driver is one profile for each language.
Prediction reads each whole text where it lies; there is no shuffle.

Defined results: ``und`` with score 0 for a null text, a text without letters, or
when nothing was learned; null languages are not learned; ties go to the
first name; repeated rows are alike; a text of any length is read whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linear import held_out
from .shared import Scratch
from .textkit import each_batch, release

PROFILE = 400
FOLDS, FOLD = 4, 2
UNKNOWN = "und"

#: The blank, beyond all code points, so that an n-gram of any length is a number by itself: 21 bits for each character.
BLANK = 0x110000
#: Codes that may wait to be counted.
WAITING = 1 << 22


def symbols(text: str) -> np.ndarray:
    """The lower-cased code points of a text, with single blanks around words."""
    own = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    seen, at = np.unique(own, return_inverse=True)
    letter = np.array([unicodedata.category(chr(c))[0] in "LM" for c in seen.tolist()], dtype=bool)
    own = np.where(letter[at], own, BLANK) if len(own) else own
    own = np.concatenate([[BLANK], own, [BLANK]])
    keep = np.ones(len(own), dtype=bool)
    keep[1:] = (own[1:] != BLANK) | (own[:-1] != BLANK)
    return own[keep]


def codes(texts: pa.Array):
    """For each text, the codes of all its n-grams; blanks come singly and only at an end."""
    for t in texts:
        own = symbols(t.as_py() or "")
        if len(own) < 3:
            yield np.zeros(0, np.int64)
            continue
        two = own[:-1] << 21 | own[1:]
        three = own[1:-1] != BLANK
        yield np.concatenate([own[own != BLANK], two, (two[:-1] << 21 | own[2:])[three]])


def ranked(code: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    u, n = np.unique(code, return_counts=True)
    if len(u) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        u, n = u[n >= least], n[n >= least]
    return u[np.argsort(-n, kind="stable")][:most]


def profiles(docs: DataFrame, *, id: str, text: str, lang: str) -> dict[str, np.ndarray]:
    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def merge():
            for k, lists in waiting.items():
                u, n = np.unique(np.concatenate(lists), return_counts=True)
                if k in sums:
                    both, at = np.unique(np.concatenate([sums[k][0], u]), return_inverse=True)
                    u, n = both, np.bincount(at, weights=np.concatenate([sums[k][1], n])).astype(np.int64)
                sums[k] = u, n
            waiting.clear()

        for b in batches:
            for k, c in zip(b.column(1).to_pylist(), codes(b.column(0)), strict=True):
                waiting.setdefault(k, []).append(c)
                size += len(c)
                if size > WAITING:
                    merge()
                    size = 0
        merge()
        for k, (u, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(u), type=pa.string()), pa.array(u), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])
        release()

    learn = docs.where(~held_out(id, FOLDS, FOLD)).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = learn.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    got = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "code"))).alias("p"))
    return {r.lang: np.array([x.code for x in r.p], dtype=np.int64) for r in sorted(got.collect(), key=lambda r: r.lang)}


def distances(own: np.ndarray, sides) -> list[int]:
    """Out-of-place distance of ranked codes to each profile, given as sorted codes with their ranks."""
    place = np.arange(len(own))
    out = []
    for sorted_codes, rank in sides:
        at = np.minimum(np.searchsorted(sorted_codes, own), len(sorted_codes) - 1)
        out.append(int(np.where(sorted_codes[at] == own, np.abs(rank[at] - place), PROFILE).sum()))
    return out


def identify(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """For each document: id, held_out, lang_pred, score (1 less the distance as a share of the greatest)."""
    known = profiles(docs, id=id, text=text, lang=lang)
    names, sides = list(known), []
    for p in known.values():
        order = np.argsort(p)
        sides.append((p[order], order))

    def nearest(texts: pa.Array) -> pa.Array:
        best, score = [], []
        for t, c in zip(texts.is_valid().to_pylist(), codes(texts), strict=True):
            own = ranked(c) if t and names else c[:0]
            if not len(own):
                best.append(UNKNOWN)
                score.append(0.0)
                continue
            d = distances(own, sides)
            k = int(np.argmin(d))
            best.append(names[k])
            score.append(1.0 - d[k] / (PROFILE * len(own)))
        return pa.StructArray.from_arrays([pa.array(best, type=pa.string()), pa.array(score, type=pa.float64())], names=["lang", "score"])

    @F.arrow_udf("struct<lang:string,score:double>")
    def nearest_profile(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_batch(nearest, batches)

    letters = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    out = docs.select(F.col(id).alias(id), held_out(id, FOLDS, FOLD).alias("held_out"), nearest_profile(letters).alias("x"))
    return out.select(id, "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))
