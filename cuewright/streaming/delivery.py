"""Delivery that loses nothing: each message once, in order, and everything else named in a dead letter.

A micro-batch of events is routed in one pass (``lookup.routed``).  Each row then meets the memory of its lane, which
knows the rows of the last ``horizon`` of event time: a row seen before goes, a new one is passed on.  A row older than what the
lane remembers cannot be told from a copy, so it is neither dropped nor sent but becomes a dead letter, ``late``, with its
route as detail.  Lanes split a target's rows by event id, so that two targets do not mean two tasks.

Memory is kept by spans of event time, a packed set of (event, step) each; spans behind the horizon are forgotten as
a whole, so state is bounded by what a horizon holds.  The sink writes a micro-batch once, by route, sorted by
target and event, into a folder of its own, which a micro-batch that is run again overwrites.  Order for a target is by
(epoch, seq, step).

Defined results: events without a time never age and are remembered for good, each in the one span of its own; no events
give no rows; a copy in the same micro-batch counts as seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import lookup, store
from ..operators.scan import RANGE, Ranges
from ..sources import model
from ..sources.shared_folder import ship_code

ROUTED = "seq bigint, step int, at bigint, action_pos int, macro_name string, daw string, track string, track_index int, address string, value double, detail string, route string"
#: A horizon is remembered in so many spans, and one more.
SPANS = 16
#: The span of events that have no time.
TIMELESS = -(1 << 62)


class Once(StatefulProcessor):
    """Passes on the rows of a lane that it has not seen, and names those that are older than it remembers."""

    def __init__(self, horizon: int):
        self.horizon, self.width = horizon, max(horizon // SPANS, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "span bigint", "packed binary")
        self.newest = handle.getValueState("newest", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        floor = None if newest is None else newest - self.horizon
        known: dict[int, set] = {}
        for frame in rows:
            span = np.where(frame["at"].isna(), TIMELESS, frame["at"].fillna(0).astype("int64") // self.width)
            late = np.zeros(len(frame), dtype=bool) if floor is None else (frame["at"] < floor).to_numpy()
            keep = np.ones(len(frame), dtype=bool)
            for i, (s, seq, step) in enumerate(zip(span.tolist(), frame["seq"].tolist(), frame["step"].tolist(), strict=True)):
                if late[i]:
                    continue
                if s not in known:
                    known[s] = self.load(s)
                if (seq, step) in known[s]:
                    keep[i] = False
                else:
                    known[s].add((seq, step))
            top = frame["at"].max()
            if not pd.isna(top):
                newest = int(top) if newest is None else max(newest, int(top))
            out = frame.copy()
            out["detail"] = out["detail"].where(~late, out["route"])
            out["route"] = out["route"].where(~late, "late")
            yield out[keep][[f.split(" ")[0] for f in ROUTED.split(", ")]]
        for s, ids in known.items():
            self.seen.updateValue((s,), (np.array(sorted(ids), dtype=np.int64).tobytes(),))
        if newest is not None:
            self.newest.update((newest,))
            self.forget(newest - self.horizon)

    def load(self, span: int) -> set:
        if not self.seen.containsKey((span,)):
            return set()
        return set(map(tuple, np.frombuffer(self.seen.getValue((span,))[0], dtype=np.int64).reshape(-1, 2).tolist()))

    def forget(self, floor: int) -> None:
        """Drop the spans that end before the floor."""
        for (span,) in list(self.seen.keys()):
            if span != TIMELESS and (span + 1) * self.width <= floor:
                self.seen.removeKey((span,))

    def close(self) -> None:
        pass


def device_stream(events: DataFrame) -> DataFrame:
    """Device events with their time in microseconds as ``at``."""
    return events.select(*model.event_columns(), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def deliver(events: DataFrame, at: str, macros: DataFrame, tracks: DataFrame, daws: DataFrame, *, horizon: str = "1 hour", lanes: int = 16) -> None:
    """Route, tell copies and write what a stream of events has for now; called again with the same folder it goes on from there."""
    spark = events.sparkSession
    ship_code(spark)
    micros = int(pd.Timedelta(horizon).total_seconds() * 1_000_000)
    rows = lookup.routed(device_stream(events), macros, tracks, daws, "at")
    target = F.when(F.col("route") == "message", F.col("daw")).otherwise(F.col("route"))
    keyed = rows.withColumns({"target": target, "lane": F.pmod("seq", F.lit(lanes))})
    once = keyed.groupBy("target", "lane").transformWithStateInPandas(Once(micros), outputStructType=ROUTED, outputMode="Append", timeMode="None")

    def each(batch: DataFrame, epoch: int) -> None:
        batch.sortWithinPartitions("route", "daw", "seq", "step").write.mode("overwrite").partitionBy("route").parquet(f"{at}/out/epoch={epoch}")

    with store.rocksdb(spark):
        once.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def delivered(spark: SparkSession, at: str) -> DataFrame:
    """All rows written so far, with their epoch and route; none where nothing was written."""
    return store.open_table(spark, f"{at}/out", f"{ROUTED}, epoch bigint")


def numbered(rows: DataFrame) -> DataFrame:
    """Messages with ``place``, their number in the order of their target; ranges split a target."""
    r = Ranges(rows.where("route = 'message'"), ["daw"], ["epoch", "seq", "step"])
    return r.fold(r.rows, "place", "sum", F.lit(1)).drop(RANGE)
