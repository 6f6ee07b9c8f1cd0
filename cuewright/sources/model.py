"""Schemas, seed relations, and projections of the star-schema tables onto the engine's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

ACTIONS = "array<struct<daw string, track string, command string, value double>>"
DOCUMENT = "struct<blocks array<struct<id bigint, name string, length double>>>"
SETTINGS = "id bigint, key string, value string"
MAPPINGS = "id bigint, name string, type string, mapping string, actions_json string"
ARRANGEMENT = "id bigint, name string, data string"
STATUS = "bpm double, is_playing boolean, is_recording boolean, is_connected boolean"

# The seed rows, the tracks, the two targets and the initial status.
SEED_SETTINGS = [("reaper_port", "9000"), ("ableton_port", "9001"), ("default_bpm", "120"), ("track_list", "DRUMS,BASS,KEYS,VOCALS")]
SEED_BLOCKS = [(1, "Intro", 8), (2, "Verse", 16), (3, "Chorus", 16)]
SEED_MACRO = 60
TARGETS = [("reaper", "127.0.0.1", 9000), ("ableton", "127.0.0.1", 9001)]
INITIAL_STATUS = (120.0, False, False, False)
TRACKS = "ECONOMY,LARGE,MEDIUM,PROMO,SMALL"
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CELLS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Constant rows whose size the planner knows, so that joins with them are broadcast."""
    fields = StructType.fromDDL(schema).fields
    row = lambda r: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields, strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(row, rows))))


def seed_settings(spark: SparkSession) -> DataFrame:
    return literal(spark, [(i + 1, k, v) for i, (k, v) in enumerate(SEED_SETTINGS)], SETTINGS)


def seed_mappings(spark: SparkSession) -> DataFrame:
    action = '{{"daw":"{0}","track":"DRUMS","command":"volume","value":1}}'
    return literal(spark, [(SEED_MACRO, "Drums up", "note", str(SEED_MACRO), f"[{action.format('reaper')},{action.format('ableton')}]")], MAPPINGS)


def seed_arrangement(spark: SparkSession) -> DataFrame:
    blocks = ",".join(f'{{"id":{i},"name":"{n}","length":{k}}}' for i, n, k in SEED_BLOCKS)
    return literal(spark, [(1, "Default", f'{{"blocks":[{blocks}]}}')], ARRANGEMENT)


def daws(spark: SparkSession) -> DataFrame:
    return literal(spark, [(i, *x) for i, x in enumerate(TARGETS)], "daw_pos int, daw string, host string, port int")


def event_columns() -> list[Column]:
    """Device events from the events table: sparse fields by type."""
    kind = F.create_map(*[F.lit(x) for k, v in {"click": "noteon", "view": "noteoff", "purchase": "cc", "signup": "pitch", "error": "program"}.items() for x in (k, v)])
    note = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    return [
        F.col("event_id").alias("seq"),
        kind[t].alias("_type"),
        (F.col("user_id") % 16).cast("int").alias("channel"),
        note.alias("note"),
        F.when(t.isin("click", "view"), (F.col("user_id") % 128).cast("int")).alias("velocity"),
        F.when(t == "purchase", (F.col("user_id") % 120).cast("int")).alias("controller"),
        F.when(~t.isin("click", "view"), F.col("value")).alias("value"),
    ]


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*event_columns())


def macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros from all parts: a note number, a name and one to three actions as JSON text; note 0 has none."""
    p = table(spark, sf_dir, "part")
    types = F.array(*map(F.lit, TYPES))

    def action(j: int) -> Column:
        daw = F.when((F.col("p_partkey") % 11 == 0) & F.lit(j == 1), "logic").when((F.col("p_partkey") + j) % 2 == 0, "reaper").otherwise("ableton")
        track = F.col("p_type") if j == 0 else F.get(types, ((F.col("p_size") + j) % 6).cast("int"))
        return F.concat(F.lit('{"daw":"'), daw, F.lit('","track":"'), track, F.lit('","command":"' + ("volume", "pan", "mute")[j] + '","value":'), (F.col("p_size") + j).cast("string"), F.lit("}"))

    n = F.col("p_partkey") % 3
    text = F.concat(F.lit("["), action(0), F.when(n >= 1, F.concat(F.lit(","), action(1))).otherwise(""), F.when(n >= 2, F.concat(F.lit(","), action(2))).otherwise(""), F.lit("]"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("note").alias("type"), F.col("p_partkey").cast("string").alias("mapping"), text.alias("actions_json"))


def track_map(spark: SparkSession, tracks: str | None = TRACKS) -> DataFrame:
    """Tracks of a comma list, numbered from 1; nothing is trimmed and empty names stay."""
    one = spark.range(1).select(F.lit(tracks).cast("string").alias("value"))
    return one.select(F.posexplode(F.split("value", ",")).alias("pos", "track")).select("track", (F.col("pos") + 1).cast("int").alias("idx"))


#: What orders the lines of an order; unique with the order's key.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each arrangement (an order) by position, with the alias fields that a block may come with."""
    pos = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1).cast("int")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("arrangement"),
        pos.alias("pos"),
        F.col("l_partkey").alias("id"),
        F.when(n % 3 == 0, None).when(n % 3 == 1, "").otherwise(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("name"),
        F.when(F.col("l_returnflag") != "R", F.concat("l_returnflag", "l_linestatus")).alias("label"),
        F.when(q <= 30, q).alias("length"),
        F.when(q <= 40, q + 1).alias("bars"),
        F.when(q <= 45, q + 2).alias("bar_length"),
        F.when(F.col("l_linestatus") != "O", F.concat(F.lit("bg-"), F.lower("l_returnflag"))).alias("color"),
    )


def arrangements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, data): one for each order that has lines, blocks as JSON text."""
    b = blocks(spark, sf_dir).select("arrangement", "pos", "id", F.col("label").alias("name"), F.coalesce("length", F.lit(4.0)).alias("length"))
    inner = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "name", "length"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["length"].alias("length")))
    return b.groupBy("arrangement").agg(inner.alias("blocks")).select(F.col("arrangement").alias("id"), F.concat(F.lit("Order "), F.col("arrangement").cast("string")).alias("name"), F.to_json(F.struct("blocks")).alias("data"))
