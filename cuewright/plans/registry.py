"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import idioms
from ..operators import blocks as B
from ..operators import lookup as L
from ..operators import messages as M
from ..operators import scan, shuffle
from ..operators import state as S
from ..operators import store
from ..sources import model as D
from ..sources.shared_folder import shared_folder
from ..streaming import beat, delivery
from ..streaming import pipelines as P

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- what several checks begin with, in DuckDB SQL

EV = """ev as (select event_id as seq, case event_type when 'click' then 'noteon' when 'view' then 'noteoff' when 'purchase' then 'cc' when 'signup' then 'pitch' when 'error' then 'program' end as _type,
  cast(user_id % 16 as int) as channel, cast(json_extract_string(props, '$.k') as int) as note,
  case when event_type in ('click', 'view') then cast(user_id % 128 as int) end as velocity, case when event_type = 'purchase' then cast(user_id % 120 as int) end as controller,
  case when event_type not in ('click', 'view') then value end as value, event_type, user_id from events)"""
TYPES = "['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']"
#: Actions straight from the parts, without JSON.
ACT = f"""act as (select p_partkey as id, p_name as name, cast(j as int) as action_pos,
  case when p_partkey % 11 = 0 and j = 1 then 'logic' when (p_partkey + j) % 2 = 0 then 'reaper' else 'ableton' end as daw,
  case when j = 0 then p_type else {TYPES}[(p_size + j) % 6 + 1] end as track, ['volume', 'pan', 'mute'][j + 1] as command, cast(p_size + j as double) as value
  from part, range(3) r(j) where j <= p_partkey % 3)"""
TM = "tm as (select * from (values ('ECONOMY', 1), ('LARGE', 2), ('MEDIUM', 3), ('PROMO', 4), ('SMALL', 5)) t(track, idx))"
ADDRESS = "case daw when 'reaper' then '/track/' || idx || '/' || command when 'ableton' then '/live/track/' || idx || '/' || command else '' end"
BL = """bl as (select l_orderkey as arrangement, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as int) as pos, l_partkey as id,
  case when l_linenumber % 3 = 0 then null when l_linenumber % 3 = 1 then '' else 'P' || l_partkey end as name, case when l_returnflag <> 'R' then l_returnflag || l_linestatus end as label,
  case when l_quantity <= 30 then l_quantity end as length, case when l_quantity <= 40 then l_quantity + 1 end as bars, case when l_quantity <= 45 then l_quantity + 2 end as bar_length,
  case when l_linestatus <> 'O' then 'bg-' || lower(l_returnflag) end as color from lineitem)"""
SEED = "(values (1::bigint, 'reaper_port', '9000'), (2, 'ableton_port', '9001'), (3, 'default_bpm', '120'), (4, 'track_list', 'DRUMS,BASS,KEYS,VOCALS')) s(id, key, value)"


# --- sources


SETTINGS = f"st as (select key, value from {SEED} union all select 'user' || user_id, 'v' || max(event_id) from events group by user_id)"


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed settings and one for each user, of its last event."""
    last = D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("n"))
    own = last.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("key"), F.concat(F.lit("v"), F.col("n").cast("string")).alias("value"))
    return D.seed_settings(spark).select("key", "value").unionByName(own)


@query(f"with {SETTINGS} select key, value from st")
def settings_scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings(spark, sf_dir)


@query(f"""with {BL} select arrangement as id, 'Order ' || arrangement as name,
  '{{"blocks":[' || string_agg('{{"id":' || id || case when label is null then '' else ',"name":"' || label || '"' end || ',"length":' || cast(coalesce(length, 4.0) as varchar) || '}}', ',' order by pos) || ']}}' as data from bl group by arrangement""")
def arrangement_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arrangements(spark, sf_dir).select("*")


@query(f"with {ACT} select name, '[' || string_agg('{{\"daw\":\"' || daw || '\",\"track\":\"' || track || '\",\"command\":\"' || command || '\",\"value\":' || cast(value as int) || '}}', ',' order by action_pos) || ']' as actions_json from act where id = 60 group by name")
def macro_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.point(D.macros(spark, sf_dir), "id", D.SEED_MACRO).select("name", "actions_json")


@query(f"with {SETTINGS} select key, value from st where key in ('track_list', 'user7')")
def setting_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two settings by their keys, one of the seed and one of a user, given as parameters."""
    t = settings(spark, sf_dir)
    one = lambda key: spark.sql("select key, value from {t} where key = :key", t=t, args={"key": key})
    return one("track_list").unionByName(one("user7"))


@query(f"with {EV} select seq, _type, channel, note, velocity, controller, value from ev")
def event_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.device_events(spark, sf_dir)


@query(f"with {EV} select seq, channel, note as macro_id, velocity from ev where _type = 'noteon'")
def noteon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.noteons(D.device_events(spark, sf_dir))


@query(f"with {EV} select seq, note as macro_id, coalesce(note <> 0, false) as command_valid, note is not null as midi_valid from ev")
def command_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("note")
    return D.device_events(spark, sf_dir).select("seq", n.alias("macro_id"), L.valid_command(n).alias("command_valid"), n.isNotNull().alias("midi_valid"))


@query(f"""with {EV}, n as (select seq, row_number() over (order by seq) as n from ev where event_type = 'purchase')
  select ev.seq, case when event_type = 'purchase' then 'transport' else 'macro' end as route, case when event_type = 'purchase' then case when n.n % 2 = 1 then 'play' else 'stop' end end as command, case when event_type <> 'purchase' then note end as macro_id from ev left join n using (seq)""")
def command_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("note"))
    play = S.toggled(ev.where("event_type = 'purchase'"), "seq")
    transport = play.select("seq", F.lit("transport").alias("route"), F.when(F.col("is_playing"), "play").otherwise("stop").alias("command"), F.lit(None).cast("int").alias("macro_id"))
    rest = ev.where("event_type is null or event_type <> 'purchase'").select("seq", F.lit("macro").alias("route"), F.lit(None).cast("string").alias("command"), F.col("note").alias("macro_id"))
    return transport.unionByName(rest)


# --- lookups


@query(f"with {EV} select seq, note as macro_id, p_name as macro_name from ev join part on p_partkey = note where _type = 'noteon'")
def macro_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.match(L.noteons(D.device_events(spark, sf_dir)), D.macros(spark, sf_dir)).select("seq", "macro_id", "macro_name")


@query(f"with {EV} select seq, note as macro_id from ev where _type = 'noteon' and not exists (select 1 from part where p_partkey = note)")
def macro_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.miss(L.noteons(D.device_events(spark, sf_dir)), D.macros(spark, sf_dir)).select("seq", "macro_id")


@query(f"with {EV} select seq as event_id, p_name as name from ev join part on p_partkey = note where _type = 'noteon'")
def macro_debug_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.match(L.noteons(D.device_events(spark, sf_dir)), D.macros(spark, sf_dir)).select(F.col("seq").alias("event_id"), F.col("macro_name").alias("name"))


@query(f"with {ACT} select id, action_pos, daw, track, command, value from act")
def actions_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.actions(D.macros(spark, sf_dir), "id")


@query("select url, cast(i - 1 as int) as pos, string_split(url, '/')[i] as piece from (select url, unnest(range(1, len(string_split(url, '/')) + 1)) as i from pages)")
def track_list_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("url", F.posexplode(F.split("url", "/")).alias("pos", "piece"))


@query(f"with {ACT}, {TM} select id, action_pos, track, idx as track_index from act join tm using (track)")
def track_resolve_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve(L.actions(D.macros(spark, sf_dir), "id"), D.track_map(spark)).where("track_index is not null").select("id", "action_pos", "track", "track_index")


@query(f"with {ACT}, {TM} select id, action_pos, track from act where track not in (select track from tm)")
def track_resolve_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve(L.actions(D.macros(spark, sf_dir), "id"), D.track_map(spark)).where("track_index is null").select("id", "action_pos", "track")


@query("select p_size as idx, arg_min(p_name, p_partkey) as track from part group by p_size")
def track_reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reverse_lookup(D.table(spark, sf_dir, "part").select(F.col("p_name").alias("track"), F.col("p_size").alias("idx"), F.col("p_partkey").alias("pos")))


@query("select event_type || '-' || (user_id % 10) as track, arg_max(cast(json_extract_string(props, '$.k') as int), event_id) as idx from events group by 1")
def track_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = D.table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("track"), F.get_json_object("props", "$.k").cast("int").alias("idx"), "event_id")
    return S.last_by(ev, ["track"], "idx", "event_id")


# --- messages


@query(f"with {ACT}, {TM} select id, action_pos, {ADDRESS} as address, value as arg from act join tm using (track)")
def osc_address_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.resolve(L.actions(D.macros(spark, sf_dir), "id"), D.track_map(spark)).where("track_index is not null")
    sent = found.select("id", "action_pos", M.message(M.action_address(F.col("daw"), F.col("track_index"), F.col("command")), M.float_args(F.col("value"))).alias("m"))
    return sent.select("id", "action_pos", "m.address", F.get(M.arg_values(F.col("m.args")), F.lit(0)).cast("double").alias("arg"))


@query(f"""with {EV} select seq, daw, case daw when 'reaper' then '/track/' || note || '/arm' else '/live/track/' || note || '/arm' end as address, cast(_type = 'noteon' as int) as arg from ev, (values ('reaper'), ('ableton')) d(daw) where _type in ('noteon', 'noteoff')""")
def osc_arm_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = D.device_events(spark, sf_dir).where("_type in ('noteon', 'noteoff')").withColumn("daw", F.explode(F.array(*[F.lit(x[0]) for x in D.TARGETS])))
    args = M.int_args((F.col("_type") == "noteon").cast("int"))
    return ev.select("seq", "daw", M.arm_address(F.col("daw"), F.col("note")).alias("address"), M.first_arg(args).alias("arg"))


DISPATCH = f"with {EV}, {ACT}, {TM} select seq as event_id, action_pos, name as macro_name, daw, track, idx as track_index, {ADDRESS} as address, value from ev join act on act.id = note join tm using (track) where _type = 'noteon' and daw in ('reaper', 'ableton')"
#: Columns of the events and of the actions have one name.
DISPATCH = DISPATCH.replace(" value from ev join", " act.value as value from ev join")


@query(DISPATCH)
def macro_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: device events to messages."""
    return L.dispatch(D.device_events(spark, sf_dir), D.macros(spark, sf_dir), D.track_map(spark), D.daws(spark))


@query(DISPATCH + " and not exists (select 1 from act a join tm t on t.track = a.track where a.id = act.id and a.daw not in ('reaper', 'ableton') and a.action_pos < act.action_pos)")
def macro_dispatch_strict_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dispatch(D.device_events(spark, sf_dir), D.macros(spark, sf_dir), D.track_map(spark), D.daws(spark), strict_abort=True)


DEAD = f"""with {EV}, {ACT}, {TM}, m as (select seq, act.* from ev join act on act.id = note where _type = 'noteon')
  select seq, cast(null as int) as action_pos, 'macro miss' as reason, cast(note as varchar) as detail from ev where _type = 'noteon' and note not in (select id from act)
  union all select seq, action_pos, 'track miss', track from m where track not in (select track from tm)
  union all select seq, action_pos, 'unknown target', daw from m where track in (select track from tm) and daw not in ('reaper', 'ableton')
  union all select seq, null, 'invalid payload', cast(note as varchar) from ev where _type = 'cc' and coalesce(note, 0) = 0"""


@query(DEAD)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be sent, and why."""
    return L.dead_letters(D.device_events(spark, sf_dir), D.macros(spark, sf_dir), D.track_map(spark), D.daws(spark))


TOGGLE = "select event_id, row_number() over (order by event_id) % 2 = 1 as is_playing from events where event_type = 'purchase'"


@query(f"select event_id, daw_pos, daw, (case daw when 'reaper' then '/' else '/live/' end) || (case when is_playing then 'play' else 'stop' end) as address from ({TOGGLE}) t, (values (0, 'reaper'), (1, 'ableton')) d(daw_pos, daw)")
def transport_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.posexplode(F.array(*[F.lit(x[0]) for x in D.TARGETS])).alias("daw_pos", "daw")
    t = transport_toggle(spark, sf_dir).select("event_id", F.when(F.col("is_playing"), "play").otherwise("stop").alias("command"), each)
    return t.select("event_id", "daw_pos", "daw", M.transport_address(F.col("daw"), F.col("command")).alias("address"))


@query(TOGGLE)
def transport_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.toggled(D.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id"), "event_id")


# --- tables and folds


@query("""select user_id, arg_max(value, event_id) filter (event_type = 'click') as click, arg_max(value, event_id) filter (event_type = 'error') as error, arg_max(value, event_id) filter (event_type = 'purchase') as purchase,
  arg_max(value, event_id) filter (event_type = 'signup') as signup, arg_max(value, event_id) filter (event_type = 'view') as view from events group by user_id""")
def settings_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = S.last_by(D.table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")
    return last.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.first("value"))


NEW_SETTINGS = "select case when user_id % 50 = 0 then null when user_id % 50 = 1 then 'default_bpm' else 'user' || user_id end as key, cast(value as varchar) as value, event_id from events"


@query(f"select key, value from {SEED} union all select key, value from (select *, row_number() over (partition by key order by event_id) as n from (select key, 'v' || event_id as value, event_id from ({NEW_SETTINGS}))) where (n = 1 or key is null) and (key is null or key not in (select key from {SEED}))")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    key = F.when(u % 50 == 0, None).when(u % 50 == 1, "default_bpm").otherwise(F.concat(F.lit("user"), u.cast("string")))
    new = D.table(spark, sf_dir, "events").select(key.alias("key"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), "event_id")
    return store.insert_or_ignore(D.seed_settings(spark).select("key", "value"), new, "key", "event_id")


@query("select 60 + row_number() over (order by p_partkey) as id, p_name as name from part")
def auto_increment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = D.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return store.with_ids(D.seed_mappings(spark), new, "id", "p_partkey").select("id", "name")


@query("select c_custkey as id, c_name as key, c_mktsegment as value from customer")
def seed_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is not there yet is seeded from customers; once it has rows, another seed changes nothing."""
    at = f"{shared_folder(spark)}/settings"
    customers = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    store.snapshot(store.seed_if_empty(store.open_table(spark, at, D.SETTINGS), customers), at)
    return store.seed_if_empty(store.open_table(spark, at, D.SETTINGS), D.seed_settings(spark))


STATUS = "select event_type as field, arg_max_null(case when event_id % 10 <> 0 then value end, event_id) as value from events group by event_type"


@query(STATUS)
def status_patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), "event_id", P.patch_value().alias("value"))
    return S.last_by(patches, ["field"], "value", "event_id")


@query(f"with {EV} select arg_max(p_name, seq) as name from ev join part on p_partkey = note where _type = 'noteon'")
def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_debug_echo(spark, sf_dir).agg(F.max_by("name", "event_id").alias("name"))


@query("""with a as (select event_id, user_id, event_type, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as g from events)
  select event_id, user_id, case when row_number() over (partition by user_id, event_type, g order by event_id) % 2 = 1 then event_type end as selected from a""")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = D.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return S.selection(clicks, "user_id", "event_type", "event_id").select("event_id", "user_id", "selected")


# --- blocks


@query("select o_orderkey as arrangement, cast(i as int) as i, 'ph-' || i as block_id, 'Block ' || i as name, 'idle' as state from orders, range(1, 13) r(i)")
def placeholder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.placeholders(D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrangement")), "arrangement")


@query(f"with {BL} select o_orderkey as arrangement, cast(c as int) as pos, id, length from orders cross join range(12) r(c) left join bl on arrangement = o_orderkey and pos = c")
def grid_pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrangement"))
    return B.pad(orders, D.blocks(spark, sf_dir).select("arrangement", "pos", "id", "length"), "arrangement")


@query(f"with {BL} select arrangement, pos, name from bl union all select o_orderkey, cast(c as int), 'Block ' || (c + 1) from orders, range(12) r(c) where o_orderkey not in (select l_orderkey from lineitem)")
def grid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrangement"))
    return B.fallback(orders, D.blocks(spark, sf_dir), "arrangement")


@query(f"with {BL} select arrangement, pos, coalesce(name, label, 'Block ' || (pos + 1)) as name, coalesce(length, bars, bar_length, 4.0) as length, coalesce(color, 'bg-blue-400') as color from bl")
def block_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.blocks(spark, sf_dir)
    return b.select("arrangement", "pos", *B.normalized(*[F.col(c) for c in ("name", "label", "length", "bars", "bar_length", "color", "pos")]))


@query(f"with {BL} select arrangement, pos, case when label <> '' then label when name <> '' then name else 'Unnamed' end as text from bl")
def block_label_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.blocks(spark, sf_dir).select("arrangement", "pos", B.label_of(F.col("label"), F.col("name")).alias("text"))


WIDTH_TEXT = "case when l_linenumber % 5 = 0 then 'n/a' when l_linenumber % 5 = 1 then '' when l_linenumber % 5 = 2 then null else cast(cast(l_quantity - 3 as int) as {0}) end"


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, least(100.0::double, coalesce(try_cast({WIDTH_TEXT.format('varchar')} as double), 0) * 5) as width from lineitem")
def block_width_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", B.width_of(F.expr(WIDTH_TEXT.format("string"))).alias("width"))


@query(f"""with {BL}, m as (select o_orderkey, case when o_custkey % 9 = 0 then null else cast(o_custkey % 5 as int) end as src, cast(o_orderkey % 12 as int) as dst from orders),
  p as (select arrangement, id, pos, case when src is null or src = dst then pos when pos = src then dst when pos = dst then src else pos end as moved from bl left join m on o_orderkey = arrangement where pos < 12)
  select arrangement, cast(row_number() over (partition by arrangement order by moved) - 1 as int) as pos, id from p""")
def block_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrangement"), F.when(F.col("o_custkey") % 9 != 0, (F.col("o_custkey") % 5).cast("int")).alias("src"), (F.col("o_orderkey") % 12).cast("int").alias("dst"))
    return B.swap(D.blocks(spark, sf_dir).select("arrangement", "pos", "id"), moves, "arrangement").select("arrangement", "pos", "id")


@query(f"""with {BL}, s as (select o_orderkey, o_custkey % 300 as sel from orders), f as (select arrangement, sel, arg_min(pos, pos) as pos from bl join s on o_orderkey = arrangement where id % 300 = sel group by 1, 2)
  select o_orderkey as arrangement, f.pos as first_pos, cast(f.pos is not null as varchar) as found from s left join f on arrangement = o_orderkey""")
def selected_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    sel = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrangement"), (F.col("o_custkey") % 300).alias("sel"))
    hit = D.blocks(spark, sf_dir).select("arrangement", "pos", (F.col("id") % 300).alias("sel")).join(sel, ["arrangement", "sel"]).groupBy("arrangement").agg(F.min("pos").alias("first_pos"))
    return sel.join(hit, "arrangement", "left").select("arrangement", "first_pos", idioms.to_boolean(F.col("first_pos").isNotNull()).cast("string").alias("found"))


@query(f"""with {BL}, st as (select o_orderkey, case when o_custkey % 3 = 0 then o_custkey % 200 else 0 end as active, case when o_custkey % 3 = 1 then cast(o_custkey % 20 - 5 as int) end as idx, o_custkey % 2 = 0 as playing, o_totalprice / 100 - 200 as bpm from orders),
  n as (select arrangement, count(*) as n from bl group by arrangement),
  c as (select st.*, n, case when active <> 0 then (select min(pos) from bl where bl.arrangement = o_orderkey and bl.id = active) end as c1, case when idx is not null and n > 0 then greatest(0, least(n - 1, idx)) end as c2,
    case when playing and bpm <> 0 and n > 0 then cast(abs(floor(bpm + 0.5)) as bigint) % n end as c3 from st left join n on arrangement = o_orderkey)
  select o_orderkey as arrangement, bl.id as block_id, bl.pos as block_pos from c left join bl on bl.arrangement = o_orderkey and bl.pos = coalesce(c1, c2, c3)""")
def now_playing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    status = D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("arrangement"),
        F.when(c % 3 == 0, c % 200).otherwise(0).alias("active"),
        F.when(c % 3 == 1, (c % 20 - 5).cast("int")).alias("idx"),
        (c % 2 == 0).alias("playing"),
        (F.col("o_totalprice") / 100 - 200).alias("bpm"),
    )
    lists = D.blocks(spark, sf_dir).groupBy("arrangement").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("b"))
    b = S.now_playing(F.coalesce("b", F.array().cast("array<struct<pos:int,id:bigint>>")), [F.col("active")], F.col("idx"), F.col("playing"), F.col("bpm"))
    return status.join(lists, "arrangement", "left").select("arrangement", b.alias("x")).select("arrangement", F.col("x.id").alias("block_id"), F.col("x.pos").alias("block_pos"))


@query(f"""with {BL}, st as (select o_orderkey, case when o_custkey % 3 = 0 then 0 else o_custkey % 40 end as active, case when o_custkey % 4 = 1 then null else o_custkey % 60 end as cur, o_custkey % 80 as playing_id from orders),
  w as (select *, case when active <> 0 then active when cur <> 0 then cur when playing_id <> 0 then playing_id end as wanted from st)
  select o_orderkey as arrangement, wanted, (select min(pos) from bl where bl.arrangement = o_orderkey and bl.id % 100 = wanted) as block_pos from w""")
def now_playing_three_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first truthy of three ids names the block; an id that no block has gives none."""
    c = F.col("o_custkey")
    ids = [F.when(c % 3 == 0, 0).otherwise(c % 40).cast("bigint"), F.when(c % 4 == 1, None).otherwise(c % 60).cast("bigint"), (c % 80).cast("bigint")]
    status = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrangement"), *[x.alias(n) for x, n in zip(ids, ("active", "cur", "playing"), strict=True)])
    lists = D.blocks(spark, sf_dir).groupBy("arrangement").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("id") % 100).alias("id")))).alias("b"))
    three = [F.col(n) for n in ("active", "cur", "playing")]
    none = F.lit(None)
    b = S.now_playing(F.coalesce("b", F.array().cast("array<struct<pos:int,id:bigint>>")), three, none.cast("int"), F.lit(False), none.cast("double"))
    return status.join(lists, "arrangement", "left").select("arrangement", idioms.truthy_number(*three).alias("wanted"), b["pos"].alias("block_pos"))


@query(f"with {BL} select arrangement, pos, coalesce(id % 7 = o_custkey % 7, false) as is_selected, coalesce(o_custkey % 7 <> 0 and id % 7 = o_custkey % 7, false) as is_selected_truthy from bl join orders on o_orderkey = arrangement")
def block_is_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block whether it is the selected one: plain equality, and equality with an id that must be truthy."""
    sel = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrangement"), (F.col("o_custkey") % 7).alias("sel"))
    b = D.blocks(spark, sf_dir).select("arrangement", "pos", (F.col("id") % 7).alias("id")).join(sel, "arrangement")
    return b.select("arrangement", "pos", *[x.alias(n) for x, n in zip(B.selected(F.col("id"), F.col("sel")), ("is_selected", "is_selected_truthy"), strict=True)])


# --- text and JSON

SHAPES = "case event_id % 4 when 0 then '[{\"id\":' || event_id || ',\"name\":\"a\",\"length\":1}]' when 1 then '{\"blocks\":[{\"id\":' || event_id || ',\"name\":\"b\",\"length\":2},{\"id\":0,\"name\":\"c\",\"length\":3}]}' when 2 then '{\"abstract\":\"' || event_type || '\"}' else 'not json' end"


@query("select event_id, cast(case event_id % 4 when 0 then 1 when 1 then 2 else 0 end as int) as n_blocks, case when event_id % 4 < 2 then event_id end as first_id, case event_id % 4 when 2 then event_type end as abstract from events")
def shape_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.table(spark, sf_dir, "events").select("event_id", F.expr(SHAPES).alias("t"))
    arr = F.from_json("t", "array<struct<id bigint, name string, length double>>")
    as_list = F.when(F.col("t").startswith("["), arr)
    whole = F.when(F.col("t").startswith("{"), F.from_json("t", D.DOCUMENT)["blocks"])
    found = F.coalesce(as_list, whole, F.array().cast("array<struct<id:bigint,name:string,length:double>>"))
    return t.select("event_id", found.alias("b"), idioms.truthy_text(F.when(F.col("t").startswith("{"), F.get_json_object("t", "$.abstract"))).alias("abstract")).select("event_id", F.size("b").alias("n_blocks"), F.get("b", F.lit(0))["id"].alias("first_id"), "abstract")


@query("select event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' as again, '{\"k\":' || json_extract_string(props, '$.k') || ',\"kind\":\"' || event_type || '\"}' as merged from events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    over = F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("kind"))
    return t.select("event_id", F.to_json("p").alias("again"), F.to_json(over).alias("merged"))


@query("select p_partkey, case p_type when 'SMALL' then 'ghost' when 'LARGE' then 'primary' else 'plain' end as style, p_type || ' ' || p_brand || ' ' || p_name as title from part")
def variant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map look-up with a default variant, and an array joined by blanks."""
    styles = F.create_map(*map(F.lit, ("SMALL", "ghost", "LARGE", "primary", "default", "plain")))
    return D.table(spark, sf_dir, "part").select("p_partkey", idioms.variant(styles, F.col("p_type")).alias("style"), F.array_join(F.array("p_type", "p_brand", "p_name"), " ").alias("title"))


@query("""select event_id, case when event_id % 3 = 0 then 'live' else 'idle' end as mode, case when event_id % 3 = 1 then null else cast(user_id as varchar) end as who, event_type as kind from events""")
def status_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map laid over another: the right one wins, with nulls too."""
    left = F.create_map(F.lit("mode"), F.lit("idle"), F.lit("who"), F.col("user_id").cast("string"))
    kind = [F.lit("kind"), F.col("event_type")]
    right = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("mode"), F.lit("live"), *kind)).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("who"), F.lit(None).cast("string"), *kind)).otherwise(F.create_map(*kind))
    over = D.table(spark, sf_dir, "events").select("event_id", idioms.overlay(left, right).alias("m"))
    return over.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("mode", "who", "kind")])


@query("select event_id, case event_id % 4 when 0 then 'number' when 1 then 'string' when 2 then 'object' else 'other' end as kind from events")
def payload_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a JSON payload."""
    t = F.expr("case event_id % 4 when 0 then cast(event_id as string) when 1 then '\"' || event_type || '\"' when 2 then props else 'not json' end")
    return D.table(spark, sf_dir, "events").select("event_id", idioms.kind_of(t).alias("kind"))


@query("select page_id, url from pages order by page_id limit 1")
def first_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row in a fixed order."""
    return D.table(spark, sf_dir, "pages").select("page_id", "url").orderBy("page_id").limit(1)


@query("select page_id, case when contains(p, 'node_modules/') then split_part(split_part(p, 'node_modules/', 2), '/', 1) end as chunk from (select page_id, case when page_id % 2 = 0 then 'src/node_modules/' || split_part(url, '/', 3) || '/index.js' else url end as p from pages)")
def module_chunk_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("src/node_modules/"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/index.js"))).otherwise(F.col("url"))
    return D.table(spark, sf_dir, "pages").select("page_id", idioms.module_chunk(p).alias("chunk"))


def shuffled_sql(rows: str, order: str, seed: int, epoch: int) -> str:
    """The seeded order in SQL, round by round."""
    k, m = shuffle.HALF, shuffle.MASK
    sql = f"select *, x >> {k} as l, x & {m} as r from (select *, row_number() over (order by {order}) - 1 as x from ({rows}))"
    for key in shuffle.round_keys(seed, epoch):
        sql = f"select * replace (r as l, xor(l, ((r * {shuffle.FACTOR} + {key}) >> 13) & {m}) as r) from ({sql})"
    return f"select * exclude (x, l, r), row_number() over (order by l * {1 << k} + r) - 1 as place from ({sql})"


TRACKS = "select p_partkey as id, p_name as track, p_size as idx from part"


def all_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("track"), F.col("p_size").alias("idx"))


@query(shuffled_sql(TRACKS, "id", 7, 0))
def track_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks in the order of a seed, the same at any number of partitions."""
    return shuffle.shuffled(all_tracks(spark, sf_dir), ["id"], 7)


# --- streams, and tables on disk


@query(DISPATCH)
def stream_macro_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run_to_files(P.dispatch_stream(spark, f"{sf_dir}/events.parquet", D.macros(spark, sf_dir), D.track_map(spark), D.daws(spark)), spark)


@query(TOGGLE)
def stream_transport_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.toggle_stream(spark, f"{sf_dir}/events.parquet")


@query(STATUS)
def stream_status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.status_stream(spark, f"{sf_dir}/events.parquet")


@query("select p_partkey as id, p_name as name from part")
def snapshot_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/parts"
    store.snapshot(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), at)
    return store.open_table(spark, at, "id bigint, name string")


@query(DISPATCH)
def stream_delivery_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice; each message is delivered once, to its target's folder."""
    return P.deliver_stream(spark, [f"{sf_dir}/events.parquet"] * 2, D.macros(spark, sf_dir), D.track_map(spark), D.daws(spark))


@query(DEAD)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's side output."""
    return P.dead_letter_stream(spark, f"{sf_dir}/events.parquet", D.macros(spark, sf_dir), D.track_map(spark), D.daws(spark))


@query(STATUS)
def stream_status_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status written at each tick of the clock, read on demand."""
    return P.status_periodic(spark, f"{sf_dir}/events.parquet")


REFRESHED = f"""with {EV}, {ACT}, h as (select max(event_id) // 2 as h from events), tm as (select * from (values (0, 'ECONOMY', 1), (0, 'LARGE', 2), (1, 'LARGE', 1), (1, 'SMALL', 2)) t(later, track, idx))
  select seq as event_id, action_pos, daw, act.track, idx as track_index from ev join act on act.id = note join h on true join tm on tm.track = act.track and tm.later = cast(seq > h as int) where _type = 'noteon' and daw in ('reaper', 'ableton')"""


@query(REFRESHED)
def stream_refreshed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track list changes while one query runs; every event meets the list of its own time, also those that come after the change."""
    events = D.table(spark, sf_dir, "events")
    half = events.agg(F.floor(F.max("event_id") / 2)).first()[0]
    at = shared_folder(spark)
    change = lambda *rows: D.literal(spark, list(rows), P.TRACK_CHANGES).write.mode("append").parquet(f"{at}/tracks")
    late = F.col("event_id") % 50 == 0
    change(("ECONOMY", 1, 0), ("LARGE", 2, 0))
    events.where((F.col("event_id") <= half) & ~late).write.parquet(f"{at}/in/0")
    running = P.dispatch_versioned(spark, f"{at}/in/*", at, D.macros(spark, sf_dir), D.daws(spark))
    try:
        running.processAllAvailable()
        change(("ECONOMY", None, half + 1), ("LARGE", 1, half + 1), ("SMALL", 2, half + 1))
        events.where((F.col("event_id") > half) | late).write.parquet(f"{at}/in/1")
        running.processAllAvailable()
    finally:
        running.stop()
    sent = store.open_table(spark, f"{at}/out", "seq bigint, action_pos int, daw string, track string, track_index int, route string").where("route = 'message'")
    return sent.select(F.col("seq").alias("event_id"), "action_pos", "daw", "track", "track_index")


AS_OF = """with v as (select event_type as kind, event_id as since, user_id % 7 as idx from events where event_id % 11 = 0)
  select e.event_id, e.event_type, e.user_id, v.since, v.idx from events e asof left join v on v.kind = e.event_type and v.since <= e.event_id"""


@query(AS_OF)
def track_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the version of its kind that held at its time; kinds are few and hot, so ranges split them."""
    e = D.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    v = e.where("event_id % 11 = 0").select(F.col("event_type").alias("event_type"), F.col("event_id").alias("since"), (F.col("user_id") % 7).alias("idx"))
    return scan.as_of(e, v, "event_type", "event_id", "since").select("event_id", "event_type", "user_id", "version.since", "version.idx")


BROKEN = "id % 13 = 5"
ROUTED = f"""{EV}, {ACT}, {TM}, mac as (select p_partkey as id, p_name as name, p_partkey % 13 = 5 as bad from part),
  js as (select id, '![' || string_agg('{{"daw":"' || daw || '","track":"' || track || '","command":"' || command || '","value":' || cast(value as int) || '}}', ',' order by action_pos) || ']' as t from act group by id),
  n as (select seq, note, mac.* from ev left join mac on mac.id = note where _type = 'noteon'),
  x as (select seq, action_pos, n.name, daw, track, command, act.value from n join act on act.id = n.id where not bad),
  routed as (select seq, 0 as step, 'echo' as route, null::int as action_pos, name as macro_name, null::varchar as daw, null::varchar as track, null::int as track_index, null::varchar as address, null::double as value, name as detail from n where id is not null
  union all select seq, 1, 'malformed', null, name, null, null, null, null, null, t from n join js using (id) where bad
  union all select seq, 0, 'macro miss', null, null, null, null, null, null, null, cast(note as varchar) from n where id is null
  union all select seq, 0, 'invalid payload', null, null, null, null, null, null, null, cast(note as varchar) from ev where _type = 'cc' and coalesce(note, 0) = 0
  union all select seq, action_pos + 1, case when idx is null then 'track miss' when daw not in ('reaper', 'ableton') then 'unknown target' else 'message' end, action_pos, name, daw, track, idx,
    case when idx is not null and daw in ('reaper', 'ableton') then {ADDRESS} end, case when idx is not null and daw in ('reaper', 'ableton') then value end, case when idx is null then track when daw not in ('reaper', 'ableton') then daw end from x left join tm using (track))"""


def broken_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros of which some hold text that does not parse."""
    return D.macros(spark, sf_dir).withColumn("actions_json", F.when(F.expr(BROKEN), F.concat(F.lit("!"), "actions_json")).otherwise(F.col("actions_json")))


@query(f"with {ROUTED} select * from routed")
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that events lead to, with its route: messages, echoes and each kind of dead letter from one scan."""
    return L.routed(D.device_events(spark, sf_dir), broken_macros(spark, sf_dir), D.track_map(spark), D.daws(spark))


#: Four arrivals: the third quarter of the events, the fourth, the first and the second; each but the first with copies of the one before.
ARRIVALS, HORIZON_DAYS, LANES = [2, 3, 0, 1], 20, 16
LATE_EVENTS = f"""with {ROUTED}, q as (select event_id, list_position({ARRIVALS}, event_id * 4 // ((select max(event_id) from events) + 1)) - 1 as arrival, epoch_us(ts) as moment from events),
  came as (select event_id, moment, arrival as batch, arrival from q union all select event_id, moment, arrival + 1, arrival from q where arrival < 3),
  r as (select routed.*, moment, batch, arrival, case when route = 'message' then daw else route end as target from routed join came on event_id = seq),
  f as (select *, max(moment) over (partition by target, seq % {LANES} order by batch range between unbounded preceding and 1 preceding) - {HORIZON_DAYS} * 86400000000 as oldest from r),
  k as (select *, coalesce(moment < oldest, false) as is_late from f),
  o as (select * from k where is_late or batch = arrival)
  select seq, step, case when is_late then 'late' else route end as route, case when is_late then route else detail end as detail, daw,
    case when not is_late and route = 'message' then row_number() over (partition by daw, is_late, route order by batch, seq, step) end as place from o"""


@query(LATE_EVENTS)
def stream_delivery_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four micro-batches with copies and with events up to a month late: messages once and in order, each with its place for its target, all else named."""
    at, events = shared_folder(spark), D.table(spark, sf_dir, "events")
    part = F.floor(F.col("event_id") * 4 / (events.agg(F.max("event_id")).first()[0] + 1))
    dims = broken_macros(spark, sf_dir), D.track_map(spark), D.daws(spark)
    for i, q in enumerate(ARRIVALS):
        events.where(part.isin(ARRIVALS[max(i - 1, 0) : i + 1])).write.parquet(f"{at}/in/{i}")
        delivery.deliver(P.event_stream(spark, f"{at}/in/*"), at, *dims, horizon=f"{HORIZON_DAYS} days", lanes=LANES)
    rows = delivery.delivered(spark, at)
    columns = ["seq", "step", "route", "detail", "daw"]
    placed = delivery.numbered(rows).select(*columns, "place")
    return placed.unionByName(rows.where("route <> 'message'").select(*columns, F.lit(None).cast("bigint").alias("place")))


@query(f"with s as ({STATUS}) select s.*, true as without_input from s")
def stream_status_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status at the last of several ticks, of which all but the first came without any new event."""
    at = shared_folder(spark)
    patches = P.event_stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("field"), F.col("event_id").alias("seq"), P.patch_value().alias("value"))
    running = beat.start(patches, at)
    try:
        beat.wait_for_ticks(running, spark, at, 3)
    finally:
        beat.stop(running)
    ticks = beat.ticks(spark, at)
    whole = ticks.groupBy("tick").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).orderBy(F.desc("tick")).limit(3).collect()
    last = max(r.tick for r in whole if r.n == max(x.n for x in whole))
    quiet = len({r.seq for r in whole}) == 1  # no tick saw an event that another one did not
    return ticks.where(F.col("tick") == last).select("field", "value", F.lit(quiet).alias("without_input"))


UNIQUE = f"""with recursive o as (select row_number() over (order by c_custkey) as n, case when c_custkey % 10 <> 0 then c_custkey * 7919 % (select count(*) // 2 from customer) end as id, case when c_custkey % 17 <> 0 then 'k' || (c_custkey * 31 % (select count(*) // 3 from customer)) end as key, 'v' || c_custkey as value from customer),
  r(n, ids, keys, ok, id, key, value) as (select 0::bigint, [1::bigint, 2, 3, 4], ['reaper_port', 'ableton_port', 'default_bpm', 'track_list'], false, null::bigint, null::varchar, null::varchar
    union all select o.n, case when t.ok and o.id is not null then list_append(ids, o.id) else ids end, case when t.ok and o.key is not null then list_append(keys, o.key) else keys end, t.ok, o.id, o.key, o.value
    from r join o on o.n = r.n + 1, lateral (select coalesce(not list_contains(ids, o.id), true) and coalesce(not list_contains(keys, o.key), true) as ok) t)
  select id, key, value from r where ok union all select id, key, value from {SEED}"""


@query(UNIQUE)
def insert_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with two unique keys: a row is refused for either, and a refused row holds neither."""
    c, t = F.col("c_custkey"), D.table(spark, sf_dir, "customer")
    n = t.count()
    id = F.when(c % 10 != 0, c * 7919 % (n // 2))
    key = F.when(c % 17 != 0, F.concat(F.lit("k"), (c * 31 % (n // 3)).cast("string")))
    new = t.select(id.cast("bigint").alias("id"), key.alias("key"), F.concat(F.lit("v"), c.cast("string")).alias("value"), c.alias("n"))
    return store.insert_unique(D.seed_settings(spark), new, ["id", "key"], "n")


LIFTED = """with recursive o as (select row_number() over (order by p_partkey) as n, p_name as name, case when p_partkey % 97 = 5 then p_partkey * 3 when p_partkey % 10 = 3 then p_partkey // 2 end as given from part),
  r(n, top, id, name) as (select 0::bigint, 60::bigint, 60::bigint, null::varchar union all select o.n, greatest(top, coalesce(given, top + 1)), coalesce(given, top + 1), o.name from r join o on o.n = r.n + 1)
  select id, name from (select *, row_number() over (partition by id order by n) as k from r) where k = 1 and n > 0"""


@query(LIFTED)
def explicit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which some bring an id: it lifts all later ones, and is refused where it is taken."""
    k = F.col("p_partkey")
    given = F.when(k % 97 == 5, k * 3).when(k % 10 == 3, F.floor(k / 2))
    new = D.table(spark, sf_dir, "part").select(given.cast("bigint").alias("id"), F.col("p_name").alias("name"), k.alias("n"))
    seed = D.seed_mappings(spark).select("id", F.lit(None).cast("string").alias("name"))
    return store.insert_with_ids(seed, new, "id", "n").where("name is not null")


@query("select event_id, case when event_type = 'purchase' then 'MACRO_PLAY' else 'MACRO' end as command, cast(case when event_type <> 'purchase' then cast(json_extract_string(props, '$.k') as int) end as bigint) as macro_id from events")
def command_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands appended to the command log in two goes, and read back."""
    t = D.table(spark, sf_dir, "events")
    rows = t.select("event_id", F.when(F.col("event_type") == "purchase", "MACRO_PLAY").otherwise("MACRO").alias("command"), F.when(F.col("event_type") != "purchase", F.get_json_object("props", "$.k").cast("bigint")).alias("macro_id"))
    log = f"{shared_folder(spark)}/commands"
    for k in (0, 1):
        assert store.send(rows.where(F.col("event_id") % 2 == k), log)
    return store.open_table(spark, log, "event_id bigint, command string, macro_id bigint")


@query("select c_name as key, c_mktsegment as value from customer")
def create_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created twice and filled once, from customers."""
    name, at = f"settings_{uuid.uuid4().hex}", shared_folder(spark)
    for _ in range(2):
        store.create_table(spark, name, D.SETTINGS, at)
    D.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint"), "c_name", "c_mktsegment").write.insertInto(name)
    store.create_table(spark, name, D.SETTINGS, at)
    return spark.table(name).select("key", "value")


SHUFFLES = " union all ".join(f"select {e} as epoch, * from ({shuffled_sql(TRACKS, 'id', 7, e)})" for e in range(2))


@query(SHUFFLES)
def stream_track_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ticks of the shuffle, each with an order of its own."""
    at = shared_folder(spark)
    running = P.shuffle_stream(all_tracks(spark, sf_dir), ["id"], at, 7)
    schema = "id bigint, track string, idx int, place bigint, epoch bigint"
    try:
        beat.wait_for(running, lambda: running.lastProgress is not None and running.lastProgress["batchId"] >= 1)
    finally:
        beat.stop(running)
    return store.open_table(spark, f"{at}/out", schema).where("epoch < 2")
