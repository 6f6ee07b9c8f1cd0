"""The value idioms on edge values, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from cuewright.functions import idioms as I
from cuewright.operators import messages as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("x,want", [(-2.5, -2), (2.5, 3), (119.5, 120), (0.4, 0), (-0.6, -1)])
def test_half_up(spark, x, want):
    assert one(spark, I.half_up(F.lit(x))) == want


def test_three_null_idioms_differ(spark):
    null = F.lit(None).cast("string")
    assert one(spark, I.nullish(F.lit(""), F.lit("b"))) == ""
    assert one(spark, I.truthy_text(F.lit(""), null, F.lit("b"))) == "b"
    assert one(spark, I.truthy_text(F.lit(""), null)) is None
    assert one(spark, I.truthy_number(F.lit(0.0), F.lit(math.nan), F.lit(None).cast("double"), F.lit(5.0))) == 5.0
    assert one(spark, I.absent_default(null, F.lit("d"))) == "d"
    assert one(spark, I.to_boolean(F.lit(None).cast("boolean"))) is False


@pytest.mark.parametrize("text,want", [("7.5", 7.5), ("x", 0.0), ("", 0.0), (None, 0.0), ("NaN", 0.0), ("-3", -3.0)])
def test_to_number_and_width(spark, text, want):
    assert one(spark, I.to_number(F.lit(text).cast("string"))) == want
    assert one(spark, I.bar_width(I.to_number(F.lit(text).cast("string")))) == min(100.0, want * 5)


def test_clamp_and_bucket(spark):
    assert [one(spark, I.clamp(F.lit(i), F.lit(3))) for i in (-1, 0, 2, 9)] == [0, 0, 2, 2]
    assert one(spark, I.hash_bucket(F.lit(120.0), F.lit(3))) == 0
    assert one(spark, I.hash_bucket(F.lit(-2.5), F.lit(3))) == 2
    assert one(spark, I.hash_bucket(F.lit(1.0), F.lit(0))) is None


def test_addresses(spark):
    assert one(spark, M.action_address(F.lit("reaper"), F.lit(1), F.lit("volume"))) == "/track/1/volume"
    assert one(spark, M.action_address(F.lit("ableton"), F.lit(1), F.lit("volume"))) == "/live/track/1/volume"
    assert one(spark, M.action_address(F.lit("other"), F.lit(1), F.lit("volume"))) == ""
    assert one(spark, M.transport_address(F.lit("ableton"), F.lit("record"))) == "/live/record"
    assert one(spark, M.transport_address(F.lit("reaper"), F.lit("rewind"))) == ""
    assert one(spark, M.first_arg(M.int_args(F.lit(True)))) == 1


def test_module_chunk(spark):
    assert one(spark, I.module_chunk(F.lit("/a/node_modules/react/index.js"))) == "react"
    assert one(spark, I.module_chunk(F.lit("/a/src/x.js"))) is None
