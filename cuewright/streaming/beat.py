"""A status that is written at each tick of the clock, with or without input, and subscriptions that begin with it.

Each field of the status is a key with its newest patch and a timer.  When a timer fires the field's value is
written under that tick and the next tick is set, so a status goes out each period for as long as the query runs; a
batch that only fires timers needs no input.  A change is written as such too, with the batch that brought it: the log of
changes is what a subscriber follows.

Defined results: a null value is a value; a field of no patch has no row; patches that come late, by ``seq``, change nothing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import store
from ..sources.shared_folder import ship_code

WRITTEN = "kind string, tick bigint, field string, value double, seq bigint"


class Beat(StatefulProcessor):
    """Keeps the newest patch of a field; writes a ``change`` when it changes and a ``tick`` at each period."""

    def __init__(self, period: int):
        self.period = period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "value double, seq bigint")

    def row(self, kind: str, tick: int | None, field: str, value: float | None, seq: int) -> pd.DataFrame:
        return pd.DataFrame({"kind": [kind], "tick": pd.array([tick], dtype="Int64"), "field": [field], "value": pd.array([value], dtype="Float64"), "seq": [seq]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.newest.exists()
        before = tuple(self.newest.get()) if known else (None, None)
        value, seq = before
        for frame in rows:
            last = frame.loc[frame["seq"].idxmax()]
            if seq is None or last["seq"] > seq:
                value, seq = None if pd.isna(last["value"]) else float(last["value"]), int(last["seq"])
        if seq != before[1]:
            self.newest.update((value, seq))
        if not known:
            self.handle.registerTimer(self.after(timerValues.getCurrentProcessingTimeInMs()))
        if not known or value != before[0]:
            yield self.row("change", None, key[0], value, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, seq = self.newest.get()
        self.handle.registerTimer(self.after(timerValues.getCurrentProcessingTimeInMs()))
        yield self.row("tick", expiredTimerInfo.getExpiryTimeInMs(), key[0], value, seq)

    def after(self, now: int) -> int:
        """The next whole period, the same for all fields."""
        return (now // self.period + 1) * self.period

    def close(self) -> None:
        pass


def start(patches: DataFrame, at: str, period_ms: int = 1000):
    """The running query that writes changes and ticks of (field, seq, value) under a folder."""
    ship_code(patches.sparkSession)
    beats = patches.groupBy("field").transformWithStateInPandas(Beat(period_ms), outputStructType=WRITTEN, outputMode="Append", timeMode="ProcessingTime")

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    with store.rocksdb(patches.sparkSession):
        return beats.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(processingTime=f"{period_ms} milliseconds").start()


def written(spark: SparkSession, at: str) -> DataFrame:
    return store.open_table(spark, f"{at}/out", f"{WRITTEN}, epoch bigint")


def ticks(spark: SparkSession, at: str) -> DataFrame:
    """The status at each tick: (tick, field, value, seq)."""
    return written(spark, at).where("kind = 'tick'").select("tick", "field", "value", "seq")


def snapshot(spark: SparkSession, at: str, epoch: int | None = None) -> DataFrame:
    """The status as changes up to an epoch (all of them by default) made it: (field, value, epoch of its change)."""
    changes = written(spark, at).where("kind = 'change'")
    if epoch is not None:
        changes = changes.where(F.col("epoch") <= epoch)
    return changes.groupBy("field").agg(F.max_by(F.struct("value", "epoch"), "epoch").alias("x")).select("field", "x.value", "x.epoch")


def subscribe(spark: SparkSession, at: str) -> tuple[DataFrame, int]:
    """The status for a new subscriber, and the epoch up to which it holds; ``follow`` goes on after that epoch.

    Epochs are written one after the other, so all before the newest are whole; the newest may not be yet, and is left to ``follow``.
    """
    newest = written(spark, at).agg(F.max("epoch")).first()[0]
    epoch = -1 if newest is None else newest - 1
    return snapshot(spark, at, epoch), epoch


def follow(spark: SparkSession, at: str, epoch: int) -> DataFrame:
    """The changes after an epoch: with the snapshot of that epoch, every change exactly once."""
    return written(spark, at).where("kind = 'change'").where(F.col("epoch") > epoch).select("epoch", "field", "value", "seq")


def stop(query, seconds: float = 20) -> None:
    """End the query, between two batches if one ends in time."""
    until = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.02)
    query.stop()


def wait_for(query, done, seconds: float = 120) -> None:
    """Until ``done()``; an error if the query fails or takes too long."""
    until = time.monotonic() + seconds
    while not done():
        if (failed := query.exception()) is not None:
            raise failed
        if time.monotonic() > until:
            raise TimeoutError(f"not done in {seconds} s")
        time.sleep(0.2)


def wait_for_ticks(query, spark: SparkSession, at: str, n: int, seconds: float = 120) -> None:
    """Until n ticks are written."""
    wait_for(query, lambda: ticks(spark, at).select("tick").distinct().count() >= n, seconds)
