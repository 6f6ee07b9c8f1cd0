"""Events matched with macros, actions exploded, tracks resolved, misses set apart.

Dimensions (macros, tracks, targets) are plain joins: Spark broadcasts them
when their size allows and shuffles by key when it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.model import ACTIONS
from .messages import action_address, first_arg, float_args


def point(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key, pushed down to the scan."""
    return df.where(F.col(key) == F.lit(value))


def noteons(events: DataFrame) -> DataFrame:
    """(seq, channel, macro_id, velocity): the note of a noteon names a macro; note 0 is valid here."""
    return events.where(F.col("_type") == "noteon").select("seq", "channel", F.col("note").alias("macro_id"), "velocity")


def valid_command(macro_id: Column) -> Column:
    """Commands need an id that is neither null nor 0."""
    return F.coalesce(macro_id != 0, F.lit(False))


def match(notes: DataFrame, macros: DataFrame) -> DataFrame:
    m = macros.select(F.col("id").alias("macro_id"), F.col("name").alias("macro_name"), "actions_json")
    return notes.join(m, "macro_id")


def miss(notes: DataFrame, macros: DataFrame) -> DataFrame:
    return notes.join(macros.select(F.col("id").alias("macro_id")), "macro_id", "left_anti")


def actions(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each action of ``actions_json``, in order; malformed text gives none."""
    parsed = df.select(*keep, F.posexplode(F.from_json("actions_json", ACTIONS)).alias("action_pos", "a"))
    return parsed.select(*keep, "action_pos", "a.*")


def malformed(df: DataFrame) -> DataFrame:
    """Rows whose action text does not parse, for the errors table."""
    return df.where(F.from_json("actions_json", ACTIONS).isNull())


def resolve(acts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Actions with track_index; null where the track is unknown."""
    return acts.join(tracks.withColumnRenamed("idx", "track_index"), "track", "left")


def strict(resolved: DataFrame, daws: DataFrame, *event: str) -> DataFrame:
    """Actions before the first one that has a known track and an unknown target, for each event."""
    known = resolved.join(daws.select("daw", F.lit(True).alias("known")), "daw", "left")
    stop = F.min(F.when(F.col("known").isNull() & F.col("track_index").isNotNull(), F.col("action_pos"))).over(Window.partitionBy(*event))
    return known.withColumn("stop", stop).where("stop is null or action_pos < stop").drop("stop", "known")


def dispatch(events: DataFrame, macros: DataFrame, tracks: DataFrame, daws: DataFrame, strict_abort: bool = False) -> DataFrame:
    """Events to messages: (event_id, action_pos, macro_name, daw, track, track_index, address, value)."""
    met = match(noteons(events), macros)
    found = resolve(actions(met, "seq", "macro_name"), tracks)
    if strict_abort:
        found = strict(found, daws, "seq")
    sent = found.where("track_index is not null").join(daws.select("daw"), "daw")
    return sent.select(
        F.col("seq").alias("event_id"),
        "action_pos",
        "macro_name",
        "daw",
        "track",
        "track_index",
        action_address(F.col("daw"), F.col("track_index"), F.col("command")).alias("address"),
        first_arg(float_args(F.col("value"))).cast("double").alias("value"),
    )


def versions(changes: DataFrame, key: str, since: str) -> DataFrame:
    """Changes of a dimension, (key, ..., since), as intervals: each holds from ``since`` until the next of its key."""
    following = F.lead(since).over(Window.partitionBy(key).orderBy(since))
    return changes.withColumn("valid_to", following).withColumnRenamed(since, "valid_from")


def indexed(acts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Actions with track_index, null where the track is unknown; tracks kept as ``versions`` give the index that held at the action's ``seq``."""
    t = tracks.withColumnRenamed("idx", "track_index")
    if "valid_from" not in tracks.columns:
        return acts.join(t, "track", "left")
    t = t.withColumnRenamed("track", "_track")
    held = (F.col("track") == F.col("_track")) & (F.col("seq") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("seq") < F.col("valid_to")))
    return acts.join(t, held, "left").drop("_track", "valid_from", "valid_to")


def routed(events: DataFrame, macros: DataFrame, tracks: DataFrame, daws: DataFrame, *keep: str) -> DataFrame:
    """All that events lead to, each row with its route, in one pass: (seq, step, kept columns, route, action_pos, macro_name, daw, track, track_index, address, value, detail).

    A noteon with a macro gives an ``echo`` and, for each action, a ``message``, or a ``track miss`` or an ``unknown
    target``; or ``malformed`` where the actions do not parse.  One without gives a ``macro miss``, a command without an
    id an ``invalid payload``.  ``step`` numbers an event's rows from 0.  Events are scanned once, and so is each dimension.
    """
    m = macros.select(F.col("id").alias("_id"), F.col("name").alias("macro_name"), "actions_json", F.from_json("actions_json", ACTIONS).alias("_acts"))
    is_command = F.col("_type") == "cc"
    met = events.where(F.col("_type").isin("noteon", "cc")).join(m, ~is_command & (F.col("note") == F.col("_id")), "left")
    fields = "struct<route:string,action_pos:int,daw:string,track:string,command:string,value:double,detail:string>"
    none = F.lit(None)

    def step(route: str, detail: Column) -> Column:
        return F.struct(F.lit(route), none, none, none, none, none, detail.cast("string")).cast(fields)

    acts = F.transform("_acts", lambda a, i: F.struct(F.lit("message"), i.cast("int"), a["daw"], a["track"], a["command"], a["value"], none).cast(fields))
    echo = step("echo", F.col("macro_name"))
    steps = (
        F.when(is_command, F.when(~valid_command(F.col("note")), F.array(step("invalid payload", F.col("note")))))
        .when(F.col("_id").isNull(), F.array(step("macro miss", F.col("note"))))
        .when(F.col("_acts").isNull(), F.array(echo, step("malformed", F.col("actions_json"))))
        .otherwise(F.concat(F.array(echo), acts))
    )
    each = met.select("seq", *keep, "macro_name", F.posexplode(steps).alias("step", "s")).select("seq", "step", *keep, "macro_name", "s.*")
    found = indexed(each, tracks).join(daws.select("daw", F.lit(True).alias("_known")), "daw", "left")
    action = F.col("route") == "message"
    lost, strange = action & F.col("track_index").isNull(), action & F.col("_known").isNull()
    route = F.when(lost, "track miss").when(strange, "unknown target").otherwise(F.col("route"))
    detail = F.when(lost, F.col("track")).when(strange, F.col("daw")).otherwise(F.col("detail"))
    sent = action & ~lost & ~strange
    address = F.when(sent, action_address(F.col("daw"), F.col("track_index"), F.col("command")))
    value = F.when(sent, first_arg(float_args(F.col("value"))).cast("double"))
    return found.select("seq", "step", *keep, route.alias("route"), "action_pos", "macro_name", "daw", "track", "track_index", address.alias("address"), value.alias("value"), detail.alias("detail"))


def dead_letters(events: DataFrame, macros: DataFrame, tracks: DataFrame, daws: DataFrame) -> DataFrame:
    """(seq, action_pos, reason, detail): noteons without a macro, macros that do not parse, actions whose track or target is unknown, commands without an id."""
    dead = routed(events, macros, tracks, daws).where(~F.col("route").isin("message", "echo"))
    return dead.select("seq", "action_pos", F.col("route").alias("reason"), "detail")


def reverse_lookup(tracks: DataFrame) -> DataFrame:
    """The first name of each index, in list order."""
    return tracks.groupBy("idx").agg(F.min_by("track", "pos").alias("track"))
