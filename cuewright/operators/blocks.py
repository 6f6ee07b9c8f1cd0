"""Ordered blocks of an arrangement on a fixed grid.

Order is a ``pos`` column from 0; windows are over one arrangement, whose size is that of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.idioms import absent_default, bar_width, nullish, to_number, truthy_text
from ..sources.model import CELLS


def placeholders(arrangements: DataFrame, key: str, n: int = CELLS) -> DataFrame:
    """n idle blocks, named from 1, for each arrangement."""
    each = arrangements.select(key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    number = F.col("i").cast("string")
    return each.select(key, "i", F.concat(F.lit("ph-"), number).alias("block_id"), F.concat(F.lit("Block "), number).alias("name"), F.lit("idle").alias("state"))


def pad(arrangements: DataFrame, blocks: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """Every arrangement's cells from 0, each with its block or nulls; blocks beyond the grid are cut.

    An arrangement's blocks travel as one array, so the grid is laid out after the join and not before it.
    """
    rest = [c for c in blocks.columns if c not in (key, "pos")]
    lists = blocks.where(F.col("pos") < cells).groupBy(key).agg(F.collect_list(F.struct("pos", *rest)).alias("_own"))
    grid = arrangements.select(key).join(lists, key, "left").select(key, "_own", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("pos"))
    here = grid.select(key, "pos", F.get(F.filter("_own", lambda b: b["pos"] == F.col("pos")), F.lit(0)).alias("_block"))
    return here.select(key, "pos", *[F.col(f"_block.{c}").alias(c) for c in rest])


def fallback(arrangements: DataFrame, blocks: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """Blocks where an arrangement has any, else placeholders: (key, pos, name)."""
    own = blocks.select(key, "pos", "name")
    none = arrangements.join(blocks.select(key), key, "left_anti")
    i = F.col("pos") + 1
    rest = none.select(key, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("pos")).select(key, "pos", F.concat(F.lit("Block "), i.cast("string")).alias("name"))
    return own.unionByName(rest)


def normalized(name: Column, label: Column, length: Column, bars: Column, bar_length: Column, color: Column, pos: Column) -> list[Column]:
    """name, length and color with their aliases and defaults."""
    nth = F.concat(F.lit("Block "), (pos + 1).cast("string"))
    return [nullish(name, label, nth).alias("name"), nullish(length, bars, bar_length, F.lit(4.0)).alias("length"), absent_default(color, F.lit("bg-blue-400")).alias("color")]


def label_of(label: Column, name: Column) -> Column:
    return truthy_text(label, name, F.lit("Unnamed"))


def width_of(text: Column) -> Column:
    return bar_width(to_number(text))


def swap(blocks: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Each arrangement's blocks after one move (key, src, dst), closed up and cut to the grid.

    Places src and dst trade their blocks; a move to an empty cell puts the
    block at the end, since holes close.  Nothing moves when src and dst are equal or one is missing.
    """
    m = blocks.where(F.col("pos") < CELLS).join(moves, key, "left")
    p, a, b = F.col("pos"), F.col("src"), F.col("dst")
    moved = F.when(a.isNull() | b.isNull() | (a == b), p).when(p == a, b).when(p == b, a).otherwise(p)
    w = Window.partitionBy(key).orderBy("moved")
    return m.withColumn("moved", moved).withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("moved", "src", "dst")


def selected(id: Column, wanted: Column) -> tuple[Column, Column]:
    """Whether a block is the wanted one: by equality, and by equality with an id that is neither null nor 0."""
    same = F.coalesce(id == wanted, F.lit(False))
    return same, same & F.coalesce(wanted != 0, F.lit(False))
