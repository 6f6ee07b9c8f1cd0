"""Output messages: addresses and arguments by target and command."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def action_address(daw: Column, index: Column, command: Column) -> Column:
    """The address of a track command; empty for an unknown target."""
    i = index.cast("string")
    return F.when(daw == "reaper", F.concat(F.lit("/track/"), i, F.lit("/"), command)).when(daw == "ableton", F.concat(F.lit("/live/track/"), i, F.lit("/"), command)).otherwise("")


def float_args(value: Column) -> Column:
    return F.array(F.struct(F.lit("f").alias("type"), value.cast("float").alias("value")))


def message(address: Column, args: Column) -> Column:
    return F.struct(address.alias("address"), args.alias("args"))


def arg_values(args: Column) -> Column:
    return F.transform(args, lambda a: a["value"])


def first_arg(args: Column) -> Column:
    return F.get(args, F.lit(0))["value"]


def transport_address(daw: Column, command: Column) -> Column:
    """play, stop and record; empty for any other command."""
    known = F.when(command.isin("play", "stop", "record"), command)
    prefix = F.when(daw == "reaper", "/").when(daw == "ableton", "/live/")
    return F.coalesce(F.concat(prefix, known), F.lit(""))


def arm_address(daw: Column, index: Column) -> Column:
    i = index.cast("string")
    return F.when(daw == "reaper", F.concat(F.lit("/track/"), i, F.lit("/arm"))).when(daw == "ableton", F.concat(F.lit("/live/track/"), i, F.lit("/arm"))).otherwise("")


def int_args(value: Column) -> Column:
    return F.array(F.struct(F.lit("i").alias("type"), value.cast("int").alias("value")))
