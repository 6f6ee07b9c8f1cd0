"""Quality rules with adaptive thresholds.

Two rules are fixed (too few words; too many words in repeated 3-word
windows).  All other cutoffs come from the data: each metric of the documents
that pass the fixed rules goes into a mergeable quantile sketch for each
(language, source), and a document is rejected when it lies beyond a fence
built from its group's median and outer decile.  Where most documents have none of
something, these are 0 and say nothing about those that have some; so what is counted must
also be more than chance gives: the sketch's share of documents with any gives the rate of incidents in a
document of median length, and a document may have as many as a Poisson count of that rate and its own length
allows (``CHANCE`` deviations beyond the mean, and one).

The sketch is a histogram over integers that keeps the six leading bits of a
value (relative error under 1/32).  Sketches merge by adding counts, so they
are built with partial aggregation, a hot source costs no more than any other,
and the result does not depend on how rows were split over tasks.  A group's fence is
the mean of its own, weighted by its documents, and its language's, weighted as ``PRIOR``
documents; the language's is blended with that of everything in the same way.  So
small groups lean on larger ones smoothly, with no size at which a rule changes.

Defined results: a null text has no words; null language or source is a group
of its own; a text of no words fails the fixed rules; repeated rows are judged
alike; a text of any length is measured whole; an empty table gives an empty result;
other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import NOT_NEWLINE, NOT_SPACE, STARTS_CHAR, blocks, distinct, each_batch, grams, mix

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A group's fence counts as its documents, the larger group's as so many.
PRIOR = 200.0
#: A fence lies beyond the median by this share of it, besides the spread.
MARGIN = 0.1
#: A count may be so many deviations beyond its expectation; the share of documents with any counts as at most ``MOST_SHARE``.
CHANCE, MOST_SHARE = 8.0, 0.9
#: Metric: (numerator, denominator, scale, how many times the distance from the median to the outer decile, parts of an incident, has a lower fence too).
#: An incident is one symbol, one repeated line, or one window of three words that occurs twice (six words); a metric of no parts is no count.
METRICS = {
    "word_len": ("word_chars", "n_words", 10, 4, 0, True),
    "symbols": ("n_symbols", "n_words", 1000, 4, 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 4, 1, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 20, 6, False),
}
COUNTS = [k for k, v in METRICS.items() if v[4]]
#: Lengths, whose medians the rates of incidents are for.
SIZES = ("n_words", "n_lines")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
BASE_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in BASE) + ">"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def measure(texts: pa.Array) -> pa.Array:
    """The base metrics of each text."""
    out: list[list[np.ndarray]] = [[] for _ in BASE]
    for b in blocks(texts):
        s, e, first = b.spans(NOT_SPACE)
        h = b.hashes(s, e)
        g, g_first = grams(h, first, 3, short=False)
        row = np.repeat(np.arange(b.rows), np.diff(g_first))
        key = g ^ mix(row.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        windows = np.concatenate([order[1:][same], order[:-1][same]])
        start = windows + (first[:-1] - g_first[:-1])[row[windows]]
        covered = np.zeros(len(h) + 3, dtype=bool)
        for j in range(3):
            covered[start + j] = True
        ls, le, l_first = b.spans(NOT_NEWLINE)
        words_before = np.zeros(len(b.data) + 1, dtype=np.int64)
        np.cumsum(NOT_SPACE[b.data], out=words_before[1:])
        has_word = words_before[le] > words_before[ls]
        kept_before = np.zeros(len(ls) + 1, dtype=np.int64)
        np.cumsum(has_word, out=kept_before[1:])
        l_first = kept_before[l_first]
        n_lines = np.diff(l_first)
        _, d_first = distinct(b.hashes(ls[has_word], le[has_word]), l_first)
        for at, x in zip(out, (np.diff(first), b.count(NOT_SPACE & STARTS_CHAR), b.count(_SYMBOL), n_lines - np.diff(d_first), _per_row(covered[: len(h)], first), n_lines), strict=True):
            at.append(x.astype(np.int64))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], names=list(BASE))


def metrics(text: Column) -> Column:
    """A struct of the base metrics of a text column."""

    @F.arrow_udf(BASE_TYPE)
    def base_metrics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_batch(measure, batches)

    # Not to be worked out again for each condition that reads it.
    return base_metrics.asNondeterministic()(text)


def base_failed(m: str) -> Column:
    """The fixed rules, for a struct column of metrics."""
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (F.lit(100) * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def scaled(m: str, name: str) -> Column:
    if name in SIZES:
        return F.col(f"{m}.{name}")
    num, den, scale, *_ = METRICS[name]
    return F.expr(f"{m}.{num} * {scale} div greatest({m}.{den}, 1L)")


def bucket(x: str) -> str:
    """SQL: the least value that has the same six leading bits."""
    e = f"greatest(length(bin({x})) - 6, 0)"
    return f"shiftleft(shiftright({x}, {e}), {e})"


def sketches(measured: DataFrame, lang: str, source: str, m: str) -> DataFrame:
    """Mergeable sketches (lang, source, metric, v, c): c values of a metric in the bucket that begins at v."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), scaled(m, k).alias("x")) for k in (*METRICS, *SIZES)]))
    rows = measured.where(~base_failed(m)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("e"))
    return rows.select("lang", "source", "e.metric", F.expr(bucket("e.x")).alias("v")).groupBy("lang", "source", "metric", "v").agg(F.count("*").alias("c"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(lang, source, low_<metric>, high_<metric>, share_<metric>, mid_<metric>) from sketches, each group's blended with those of larger ones.

    share is that of documents above 0, mid the median.
    """
    none = F.lit(None).cast("string")
    langs = sketch.groupBy("lang", "metric", "v").agg(F.sum("c").alias("c")).select(F.lit(1).alias("level"), "lang", none.alias("source"), "metric", "v", "c")
    every = langs.groupBy("metric", "v").agg(F.sum("c").alias("c")).select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "metric", "v", "c")
    own = sketch.select(F.lit(0).alias("level"), "lang", "source", "metric", "v", "c")
    group = Window.partitionBy("level", "lang", "source", "metric")
    cum = own.unionByName(langs).unionByName(every).withColumn("cum", F.sum("c").over(group.orderBy("v"))).withColumn("n", F.sum("c").over(group))
    quantile = lambda p: F.min(F.when(F.col("cum") * 100 >= F.col("n") * p, F.col("v")))
    some = F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("c"))), F.lit(0)).cast("double")
    q = cum.groupBy("level", "lang", "source", "metric").agg(F.first("n").cast("double").alias("n"), some.alias("some"), quantile(10).alias("q10"), quantile(50).alias("q50"), quantile(90).alias("q90"))
    times = F.coalesce(F.create_map(*[F.lit(x) for k, v in METRICS.items() for x in (k, float(v[3]))])[F.col("metric")], F.lit(0.0))
    margin = F.lit(MARGIN) * F.col("q50")
    low, high = F.col("q50") - times * (F.col("q50") - F.col("q10")) - margin, F.col("q50") + times * (F.col("q90") - F.col("q50")) + margin
    q = q.select("level", "lang", "source", "metric", "n", low.alias("low"), high.alias("high"), (F.col("some") / F.col("n")).alias("share"), F.col("q50").cast("double").alias("mid"))
    g, l, e = q.where("level = 0").alias("g"), q.where("level = 1").alias("l"), q.where("level = 2").alias("e")
    met = g.join(l, F.expr("l.lang <=> g.lang and l.metric = g.metric")).join(e, F.expr("e.metric = g.metric"))
    blend = lambda c: F.expr(f"(g.n * g.{c} + {PRIOR}D * ((l.n * l.{c} + {PRIOR}D * e.{c}) / (l.n + {PRIOR}D))) / (g.n + {PRIOR}D)").alias(c)
    met = met.select("g.lang", "g.source", "g.metric", *map(blend, ("low", "high", "share", "mid")))
    wanted = [("low", METRICS), ("high", METRICS), ("share", COUNTS), ("mid", SIZES)]
    return met.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, F.col(c))).alias(f"{c}_{k}") for c, ks in wanted for k in ks])


def chance(m: str, name: str) -> Column:
    """How many incidents a document of its length may have, once its group's cutoffs are joined."""
    den = METRICS[name][1]
    rate = -F.log(1 - F.least(F.col(f"share_{name}"), F.lit(MOST_SHARE)))
    mean = rate * F.col(f"{m}.{den}") / F.greatest(F.col(f"mid_{den}"), F.lit(1.0))
    return 1 + mean + CHANCE * F.sqrt(mean)


def verdict(m: str) -> Column:
    """Whether a row stays, once its group's cutoffs are joined."""
    ok = ~base_failed(m)
    for k, (num, _, _, _, parts, both) in METRICS.items():
        within = scaled(m, k) <= F.col(f"high_{k}")
        ok = ok & (within | (F.col(f"{m}.{num}") <= parts * chance(m, k)) if parts else within)
        if both:
            ok = ok & (scaled(m, k) >= F.col(f"low_{k}"))
    return F.coalesce(ok, F.lit(False))


def with_cutoffs(rows: DataFrame, cuts: DataFrame, lang: str, source: str) -> DataFrame:
    c = cuts.withColumnRenamed("lang", "_cut_lang").withColumnRenamed("source", "_cut_source")
    return rows.join(c, F.col(lang).eqNullSafe(F.col("_cut_lang")) & F.col(source).eqNullSafe(F.col("_cut_source")), "left").drop("_cut_lang", "_cut_source")


def score(docs: DataFrame, scratch, *, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """For each document: id, the base metrics, base_failed, kept."""
    rows = docs.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), metrics(F.col(text)).alias("m"))
    measured = scratch.save(rows)
    cuts = cutoffs(sketches(measured, "lang", "source", "m"))
    judged = with_cutoffs(measured, cuts, "lang", "source")
    return judged.select(F.col("id").alias(id), *[F.col(f"m.{c}") for c in BASE[:-1]], base_failed("m").alias("base_failed"), verdict("m").alias("kept"))


def keep(docs: DataFrame, scratch, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that stay, with their columns; texts are measured twice rather than shuffled.

    The sketches, which are small, are saved, so the cutoffs measure no text again.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), metrics(F.col(text)).alias("m"))
    cuts = scratch.save(cutoffs(scratch.save(sketches(rows, "lang", "source", "m"))))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), metrics(F.col(text)).alias("_m"))
    held = held.withColumn("_lang", F.col(f"_row.`{lang}`")).withColumn("_source", F.col(f"_row.`{source}`"))
    return with_cutoffs(held, cuts, "_lang", "_source").where(verdict("_m")).select("_row.*")


#: The contract in DuckDB SQL: metrics, sketches, cutoffs and verdict.
ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
tri as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
rep as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 3)) as p from (select *, count(*) over (partition by rid, g) as c from tri) where c > 1) group by rid),
ln as (select rid, count(*) as n, count(distinct l) as u from (select rid, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
m as (select d.rid, doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(ln.n - u, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(ln.n, 0) as n_lines from d join w using (rid) left join rep using (rid) left join ln using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, word_chars * 10 // greatest(n_words, 1) as word_len, n_symbols * 1000 // greatest(n_words, 1) as symbols,
  n_dup_lines * 1000 // greatest(n_lines, 1) as dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) as repeats from m),
x as (select lang, source, metric, cast(v as bigint) as v from (unpivot (select lang, source, word_len, symbols, dup_lines, repeats, n_words, n_lines from b where not base_failed) on word_len, symbols, dup_lines, repeats, n_words, n_lines into name metric value v)),
h as (select lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as v, count(*) as c from x group by all),
lv as (select 0 as level, lang, source, metric, v, c from h union all select 1, lang, null, metric, v, sum(c) from h group by lang, metric, v union all select 2, null, null, metric, v, sum(c) from h group by metric, v),
cu as (select *, sum(c) over (partition by level, lang, source, metric order by v) as cum, sum(c) over (partition by level, lang, source, metric) as n from lv),
q as (select level, lang, source, metric, cast(max(n) as double) as n, cast(coalesce(sum(c) filter (v > 0), 0) as double) as positive, cast(min(v) filter (cum * 100 >= n * 10) as double) as q10, cast(min(v) filter (cum * 100 >= n * 50) as double) as q50, cast(min(v) filter (cum * 100 >= n * 90) as double) as q90 from cu group by 1, 2, 3, 4),
f as (select *, cast(case metric when 'repeats' then 20 else 4 end as double) as times, cast(0.1 as double) * q50 as margin from q),
h2 as (select level, lang, source, metric, n, positive / n as share, q50 as mid, q50 - times * (q50 - q10) - margin as low, q50 + times * (q90 - q50) + margin as high from f),
bl as (select g.lang, g.source, g.metric, (g.n * g.low + 200::double * ((l.n * l.low + 200::double * e.low) / (l.n + 200::double))) / (g.n + 200::double) as low,
  (g.n * g.high + 200::double * ((l.n * l.high + 200::double * e.high) / (l.n + 200::double))) / (g.n + 200::double) as high,
  (g.n * g.share + 200::double * ((l.n * l.share + 200::double * e.share) / (l.n + 200::double))) / (g.n + 200::double) as share,
  (g.n * g.mid + 200::double * ((l.n * l.mid + 200::double * e.mid) / (l.n + 200::double))) / (g.n + 200::double) as mid
  from h2 g join h2 l on g.level = 0 and l.level = 1 and l.lang is not distinct from g.lang and l.metric = g.metric join h2 e on e.level = 2 and e.metric = g.metric),
a as (select lang, source, max(low) filter (metric = 'word_len') as low_word_len, max(high) filter (metric = 'word_len') as high_word_len, max(high) filter (metric = 'symbols') as high_symbols,
  max(high) filter (metric = 'dup_lines') as high_dup_lines, max(high) filter (metric = 'repeats') as high_repeats,
  greatest(max(mid) filter (metric = 'n_words'), 1.0) as mid_words, greatest(max(mid) filter (metric = 'n_lines'), 1.0) as mid_lines,
  -ln(1 - least(max(share) filter (metric = 'symbols'), 0.9)) as rate_symbols, -ln(1 - least(max(share) filter (metric = 'dup_lines'), 0.9)) as rate_dup_lines,
  -ln(1 - least(max(share) filter (metric = 'repeats'), 0.9)) as rate_repeats from bl group by 1, 2),
j as (select b.*, a.* exclude (lang, source), rate_symbols * n_words / mid_words as e_symbols, rate_dup_lines * n_lines / mid_lines as e_dup_lines, rate_repeats * n_words / mid_words as e_repeats
  from b left join a on a.lang is not distinct from b.lang and a.source is not distinct from b.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(not base_failed and word_len <= high_word_len and word_len >= low_word_len and (symbols <= high_symbols or n_symbols <= 1 + e_symbols + 8 * sqrt(e_symbols))
    and (dup_lines <= high_dup_lines or n_dup_lines <= 1 + e_dup_lines + 8 * sqrt(e_dup_lines))
    and (repeats <= high_repeats or n_repeat_words <= 6 * (1 + e_repeats + 8 * sqrt(e_repeats))), false) as kept
from j
"""
