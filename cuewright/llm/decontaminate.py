"""Benchmark decontamination by winnowing, in DataFrame operations only.

Method.  A text's words give 6-word hashes; of each 8 consecutive ones (the
13 words of a window) the least is kept, so any shared run of 13 words shares
a kept fingerprint.  Documents' fingerprints are joined with the benchmark's,
and each hit is extended to the left and right: every window of 13 words that has the hit
inside is compared with the benchmark's windows by its words.  An item of fewer than 13 words is one
window and is found by the hash of one of its words (a window of one-word hashes as long as
the item), then compared whole.  Hashes only choose candidates; words decide.

Scale.  One pass computes fingerprints; the benchmark's side is small and
Spark broadcasts it when its measured size allows, else both sides are
shuffled by hash.  Results are kept by content, so copies of a document are one key, and a
hot fingerprint or copy group is only ever joined, with skew splitting, or
aggregated with partial sums.  A place in a text meets each distinct window once, however often the
benchmark repeats it, so runs of one word cost no more than other texts.  Texts of documents with
candidates are found again by a join that broadcasts the candidates only below a checked size.

Defined results: null or wordless texts have no words and no hits; repeated
rows and null ids are judged by their text; a text of any length is read whole; a null item id marks words but is
not listed; an empty benchmark or documents table gives no hits or no rows;
other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, small_side

WINDOW = 13
GRAM = 6
PER_WINDOW = WINDOW - GRAM + 1
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of ASCII letters and digits and all other characters beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hashes(w: Column) -> Column:
    """The hash of the 6 words from each position; none for fewer than 13 words."""
    n = F.size(w)
    at = F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1)))
    return F.when(n >= WINDOW, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, GRAM)))).otherwise(F.array().cast("array<bigint>"))


def winnowed(g: Column) -> Column:
    """The distinct least hashes of each window."""
    n = F.size(g)
    at = F.sequence(F.lit(1), F.greatest(n - (PER_WINDOW - 1), F.lit(1)))
    return F.when(n > 0, F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(g, i, PER_WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(F.lit(1), x))


def benchmark_items(bench: DataFrame, item: str, text: str) -> DataFrame:
    """(item, w): the distinct items that have words."""
    return bench.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()


def benchmark_prints(items: DataFrame) -> DataFrame:
    """(h, q, n): the kept hashes of items of a window or more (q and n null); for shorter ones, of n words, the least hash of a word and its first place q from 0."""
    long = items.where(F.size("w") >= WINDOW).select(F.explode(bind(gram_hashes(F.col("w")), winnowed)).alias("h"), F.lit(None).cast("int").alias("q"), F.lit(None).cast("int").alias("n"))
    least = bind(word_hashes(F.col("w")), lambda g: F.struct(F.array_min(g).alias("h"), (F.array_position(g, F.array_min(g)) - 1).cast("int").alias("q")))
    short = items.where(F.size("w") < WINDOW).select(least.alias("x"), F.size("w").alias("n")).select("x.h", "x.q", "n")
    return long.unionByName(short).distinct()


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(window, item): the words of each window of each item, in one string."""
    n = F.least(F.size("w"), F.lit(WINDOW))
    at = F.sequence(F.lit(1), F.size("w") - n + 1)
    return items.select("item", F.explode(F.transform(at, lambda i: joined(F.slice("w", i, n)))).alias("window")).distinct()


def joined(w: Column) -> Column:
    """Words as one string; words have no blanks, so equal strings are equal words."""
    return F.array_join(w, " ")


def content(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def contents(docs: DataFrame, bench: DataFrame, scratch: Scratch, *, id: str, text: str, item: str, bench_text: str) -> tuple[DataFrame, DataFrame]:
    """(base: id, k1, k2, n_words) and, for texts with hits, (k1, k2, n_hit, items); k1 and k2 stand for the text."""
    items = scratch.save(benchmark_items(bench, item, bench_text))
    prints, windows = scratch.save(benchmark_prints(items)), scratch.save(benchmark_windows(items))
    short = not prints.where("n is not null").isEmpty()

    def kept(w: Column) -> Column:
        s = bind(gram_hashes(w), winnowed)
        return F.concat(s, F.array_distinct(word_hashes(w))) if short else s

    base = docs.select(F.col(id).alias("id"), *content(F.col(text)), bind(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), kept(w).alias("prints"))).alias("x"))
    base = scratch.save(base.select("id", "k1", "k2", "x.n_words", "x.prints"))
    hashes = scratch.save(prints.select("h").distinct())
    hits = base.select("k1", "k2", F.explode("prints").alias("h")).join(small_side(scratch, hashes), "h", "left_semi").distinct()
    hits = scratch.save(hits.select("k1", "k2").distinct())

    found = docs.select(*content(F.col(text)), F.col(text).alias("t")).join(small_side(scratch, hits), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    found = scratch.save(found.select("k1", "k2", words(F.col("t")).alias("w")))
    size = F.size("w").alias("size")
    # Places of hits, from 0, found by a join and not by scanning a text's hits; then the starts of the windows that have them inside.
    grams = found.select("k1", "k2", size, F.posexplode(gram_hashes(F.col("w"))).alias("p", "h")).join(small_side(scratch, hashes), "h", "left_semi")
    starts = F.sequence(F.greatest(F.col("p") - (PER_WINDOW - 1), F.lit(0)), F.least(F.col("p"), F.col("size") - WINDOW))
    places = grams.where(F.col("size") >= WINDOW).select("k1", "k2", F.explode(starts).alias("s"), F.lit(WINDOW).alias("n"))
    if short:
        least = small_side(scratch, scratch.save(prints.where("n is not null")))
        one = found.select("k1", "k2", size, F.posexplode(word_hashes(F.col("w"))).alias("p", "h")).join(least, "h")
        one = one.select("k1", "k2", (F.col("p") - F.col("q")).alias("s"), "n", "size").where((F.col("s") >= 0) & (F.col("s") + F.col("n") <= F.col("size")))
        places = places.unionByName(one.select("k1", "k2", "s", "n"))
    places = places.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "n")).alias("places"))
    window = lambda y: F.struct(y["s"].alias("s"), y["n"].alias("n"), joined(F.slice("w", y["s"] + 1, y["n"])).alias("window"))
    at = found.join(places, ["k1", "k2"]).select("k1", "k2", F.explode(F.transform("places", window)).alias("y"))
    known = scratch.save(windows.select("window").distinct())
    at = scratch.save(at.select("k1", "k2", "y.*").join(small_side(scratch, known), "window", "left_semi"))
    covered = F.expr("aggregate(array_sort(spans), named_struct('n', 0L, 'e', 0), (a, x) -> named_struct('n', a.n + greatest(x.e - greatest(x.s, a.e), 0), 'e', greatest(a.e, x.e))).n")
    spans = at.groupBy("k1", "k2").agg(F.collect_set(F.struct(F.col("s"), (F.col("s") + F.col("n")).alias("e"))).alias("spans")).select("k1", "k2", covered.alias("n_hit"))
    listed = at.select("k1", "k2", "window").distinct().join(small_side(scratch, windows), "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return base.select("id", "k1", "k2", "n_words"), scratch.save(spans.join(listed, ["k1", "k2"]))


def contamination(docs: DataFrame, bench: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", item: str = "item_id", bench_text: str = "text") -> DataFrame:
    """For each document: id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of its words, or more, hit)."""
    base, verdicts = contents(docs, bench, scratch, id=id, text=text, item=item, bench_text=bench_text)
    out = base.join(small_side(scratch, verdicts), ["k1", "k2"], "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce(F.concat_ws(",", "items"), F.lit(""))
    return out.select(F.col("id").alias(id), "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), judged(hit, F.col("n_words")).alias("contaminated"))


def judged(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def decontaminate(docs: DataFrame, bench: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", item: str = "item_id", bench_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, columns unchanged."""
    base, verdicts = contents(docs, bench, scratch, id=id, text=text, item=item, bench_text=bench_text)
    bad = base.join(small_side(scratch, verdicts), ["k1", "k2"]).where(judged(F.col("n_hit"), F.col("n_words"))).select("k1", "k2").distinct()
    bad = small_side(scratch, scratch.save(bad))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *content(F.col(text)))
    return held.join(bad, ["k1", "k2"], "left_anti").select("_row.*")


#: The contract in DuckDB SQL, with every window and no fingerprints.
ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as g from (select item_id, w, least(len(w), 13) as k, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
lens as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, lens where len(w) >= k)),
m as (select doc_id, i, dw.k, item_id from dw join bw using (k, g)),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as p from m) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, cast(item_id as varchar) as s from m where item_id is not null) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
