"""A Merkle manifest of documents: leaves, one tree for each language, proofs, and what tampering shows.

Every document is a leaf; the leaves of a language ascend by ``doc_id`` and every ``FAN`` consecutive nodes
become one, until one is left.  The languages' roots are the leaves of a last tree, by language, null first.

Leaves are sorted by ranges of (language, id), so a language of any share is spread; only the ranges' totals are
summed to give positions.  Aligned blocks of ``SPAN`` nodes then climb ``LEVELS`` levels by themselves: a block keeps
each level as one hex string, whose fixed-width substrings hash to the parents, and what stands beside a
node in its substring are its siblings.  The blocks' roots are the nodes of the next pass, so each pass has
1/``SPAN`` of the rows before.  Proofs come back down, a block at a time.

Defined results: null fields are ``-`` in a leaf; a null ``doc_id`` sorts first and is never tampered with; rows that
repeat an id stand by their leaves, so equal rows are neighbours, each with a place and a proof of its own; a null
language is a tree of its own; texts of any length are hashed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, small_side

FAN = 8
LEVELS = 3
SPAN = FAN**LEVELS
#: Characters of a digest in hex.
HEX = 64
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field as it stands in a leaf: its byte count and its text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tampered_with(doc_id: Column) -> Column:
    """The documents that the check changes: one in three by the CRC of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def numbered(scratch: Scratch, rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Each row's place ``pos`` in its ``tree``, the tree's size ``n``, and the size of the largest tree.

    Rows are sorted by ranges and written once; a range of a tree is shifted by
    the rows of that tree in the ranges before, which takes a table of ranges and trees alone.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = scratch.save(ranged.select("*", F.spark_partition_id().alias("_range"), inside.alias("_inside")))
    parts = ranged.groupBy("tree", "_range").agg(F.min("_inside").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    parts = scratch.save(parts.select("tree", "_range", shift.alias("_shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n")))
    placed = ranged.join(small_side(scratch, parts), ["tree", "_range"])
    return placed.withColumn("pos", F.col("_inside") + F.col("_shift")).drop("_range", "_inside", "_shift"), parts.agg(F.max("n")).first()[0] or 0


def runs(level: Column) -> Column:
    """The runs of siblings of a level: its substrings of FAN digests, the last one perhaps shorter."""
    width = FAN * HEX
    last = F.floor((F.length(level) - 1) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(level, i * width + 1, F.lit(width)))


def climbed(level: Column, n: Column, k: int) -> Column:
    """The next level: hashed runs while the tree has several nodes at level k, else the same node."""
    return F.when(n > FAN**k, F.array_join(F.transform(runs(level), lambda r: F.sha2(r, 256)), "")).otherwise(level)


def with_levels(blocks: DataFrame) -> DataFrame:
    """Blocks with their levels ``level0`` to ``level{LEVELS}``, the last one a single digest."""
    blocks = blocks.withColumn("level0", F.array_join(F.transform("members", lambda x: x["hash"]), ""))
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"level{k + 1}", climbed(F.col(f"level{k}"), F.col("n"), k))
    return blocks


def grow(scratch: Scratch, nodes: DataFrame, most: int) -> list[DataFrame]:
    """The blocks of each pass, from (tree, pos, n, hash and what else a node carries) to one block for each tree."""
    made = []
    while True:
        carried = [c for c in nodes.columns if c not in ("tree", "n")]
        placed = nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).groupBy("tree", "block")
        blocks = placed.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *[c for c in carried if c != "pos"]))).alias("members"))
        made.append(scratch.save(with_levels(blocks).select("tree", "block", "n", "members", F.col(f"level{LEVELS}").alias("top"))))
        most = -(-most // SPAN)
        if most <= 1:
            return made
        nodes = made[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("hash"))


def beside(run: Column, n: Column, i: Column, k: int) -> Column:
    """What stands before and after node i of a level in its run; nothing where the tree has one node there."""
    own = (i % FAN) * HEX
    both = F.struct(F.substring(run, F.lit(1), own).alias("before"), F.substring(run, own + HEX + 1, F.lit(FAN * HEX)).alias("after"))
    return F.when(n > FAN**k, both)


def descend(made: list[DataFrame], above: DataFrame) -> DataFrame:
    """A row for each node of the first pass: its members' fields as ``x``, its tree, and ``path``, its siblings from the leaf up.

    ``above`` has (tree, block, path and more) for the single block of each tree; what more it has goes down too.
    """
    keep = [c for c in above.columns if c not in ("tree", "block", "path")]
    for blocks in reversed(made):
        met = with_levels(blocks).join(above, ["tree", "block"])
        for k in range(LEVELS):
            met = met.withColumn(f"runs{k}", runs(F.col(f"level{k}")))
        met = met.select("tree", "n", "path", *keep, *[f"runs{k}" for k in range(LEVELS)], F.posexplode("members").alias("i", "x"))
        steps = []
        for k in range(LEVELS):
            at = F.floor(F.col("i") / FAN**k).cast("int")
            steps.append(beside(F.get(f"runs{k}", F.floor(at / FAN).cast("int")), F.col("n"), at, k))
        path = F.concat(F.filter(F.array(*steps), lambda s: s.isNotNull()), "path")
        nodes = met.select("tree", "x", path.alias("path"), *keep)
        above = nodes.select("tree", F.col("x.pos").alias("block"), "path", *keep)
    return nodes


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each document."""
    changed = F.when(tampered_with(F.col("doc_id")), leaf(lowered(F.col("text"))))
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("n"))  # null before all others, which stand bytewise
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf(F.col("text")).alias("hash"), changed.alias("changed"))
    nodes, most = numbered(scratch, leaves, ["doc_id", "hash"])
    own = grow(scratch, nodes, most)
    subroots = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("hash"))
    tops, most = numbered(scratch, subroots, ["name"])
    joint = grow(scratch, tops, most)
    root = joint[-1].select("tree", "block", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    by_tree = descend(joint, root).select(F.col("x.name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "root", F.col("x.hash").alias("subroot"))
    rows = descend(own, by_tree).select("x.doc_id", F.col("x.hash").alias("leaf"), "subroot", "root", "path", F.coalesce("x.changed", "x.hash").alias("start"))
    done = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("start"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(depth: int = 7, tops: int = 2) -> str:
    """The same rows in DuckDB SQL: every level of every tree by aggregation, siblings by windows over runs; for trees of up to FAN**depth leaves, FAN**tops languages."""
    value = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"
    fields = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    shifted = "list_reduce([0::bigint, 1, 2, 3, 4, 5, 6, 7], lambda a, _: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda d: ascii(d)::bigint), lambda c, b: {shifted}, 4294967295::bigint), 4294967295)"
    run = f"over (partition by tree, pos // {FAN} order by pos rows between "

    def level(name: str, rows: str) -> str:
        return f"""{name} as (select tree, pos, h, count(*) over (partition by tree) as n, coalesce(string_agg(h, '') {run}unbounded preceding and 1 preceding), '') as b,
  coalesce(string_agg(h, '') {run}1 following and unbounded following), '') as a from ({rows}))"""

    def climb(t: str, steps: int) -> list[str]:
        return [level(f"{t}{k + 1}", f"select tree, pos // {FAN} as pos, case when any_value(n) > 1 then sha256(string_agg(h, '' order by pos)) else min(h) end as h from {t}{k} group by tree, pos // {FAN}") for k in range(steps)]

    out = [
        f"d as (select doc_id, coalesce('v' || lang, 'n') as tree, {fields('text')} as leaf, case when doc_id is not null and {crc} % 3 = 0 then {fields(low)} end as changed from documents)",
        "p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from d)",
        level("t0", "select tree, pos, leaf as h from p"),
        *climb("t", depth),
        f"q as (select tree as name, h, '' as tree, row_number() over (order by tree) - 1 as pos from t{depth})",
        level("s0", "select tree, pos, h from q"),
        *climb("s", tops),
        f"f0 as (select doc_id, p.tree, p.pos, q.pos as place, leaf, q.h as subroot, s{tops}.h as root, '' as proof, coalesce(changed, leaf) as f from p join q on q.name = p.tree join s{tops} on true)",
    ]
    steps = [(f"t{k}", f"x.tree = f.tree and x.pos = f.pos // {FAN**k}") for k in range(depth)] + [(f"s{k}", f"x.pos = f.place // {FAN**k}") for k in range(tops)]
    for k, (t, on) in enumerate(steps):
        out.append(f"f{k + 1} as (select f.* replace (case when n > 1 then proof || b || a else proof end as proof, case when n > 1 then sha256(b || f || a) else f end as f) from f{k} f join {t} x on {on})")
    return "with " + ",\n".join(out) + f"\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from f{len(steps)}"


ORACLE = _oracle()
