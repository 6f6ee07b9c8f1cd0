"""Structured Streaming twins of the batch operators.

Sources are file streams (a message bus in production); sinks write to the
shared folder, and each run takes what is there (``availableNow``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, store
from ..operators.shuffle import shuffled
from ..operators.state import running_count
from ..sources import model
from ..sources.shared_folder import shared_folder
from . import delivery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Events from a folder, from a single file, which as a pattern of itself is allowed too, or from a pattern that ends in ``*``; at most ``files`` of them in a micro-batch."""
    reader = spark.readStream.schema(EVENTS)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path if path.endswith("*") else f"{path[:-1]}[{path[-1]}]")


def run_to_files(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream until its input is used up; what it appended."""
    at = shared_folder(spark)
    df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def dispatch_stream(spark: SparkSession, path: str, macros: DataFrame, tracks: DataFrame, daws: DataFrame) -> DataFrame:
    """Events to messages, row by row, with static dimensions."""
    return lookup.dispatch(event_stream(spark, path).select(*model.event_columns()), macros, tracks, daws)


def dispatch_refreshed(spark: SparkSession, path: str, dimensions, sink) -> None:
    """The same, with dimensions read anew for each micro-batch: ``dimensions()`` gives macros, tracks and targets; ``sink(df, epoch)`` stores.  Each call is a query of its own."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(lookup.dispatch(batch.select(*model.event_columns()), *dimensions()), epoch)

    at = shared_folder(spark)
    event_stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


TRACK_CHANGES = "track string, idx int, since bigint"


def dispatch_versioned(spark: SparkSession, path: str, at: str, macros: DataFrame, daws: DataFrame):
    """The running query that sends events by the track list of their own time, into ``{at}/out``, from one checkpoint.

    Changes of the list (``TRACK_CHANGES``; a null index takes a track away) may be appended to ``{at}/tracks`` while it runs.
    Each micro-batch reads them anew as intervals, so an event that comes late still meets the list that held when it happened.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        tracks = lookup.versions(store.open_table(spark, f"{at}/tracks", TRACK_CHANGES), "track", "since")
        rows = lookup.routed(batch.select(*model.event_columns()), macros, tracks, daws)
        rows.write.mode("overwrite").partitionBy("route").parquet(f"{at}/out/epoch={epoch}")

    return event_stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(processingTime="200 milliseconds").start()


def toggle_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The transport's state after each toggle command.

    The flag is one for the whole stream, so it is the parity of a count.  A micro-batch is counted over ranges, as the batch
    twin does, on top of the count that the epoch before has left; no task holds a whole batch.  A micro-batch
    that is run again finds the same count and overwrites its own folders.
    """
    at = shared_folder(spark)
    commands = event_stream(spark, path, files).where("event_type = 'purchase'").select("event_id")

    def each(batch: DataFrame, epoch: int) -> None:
        done = store.open_table(spark, f"{at}/counts", "n bigint, epoch bigint").where(F.col("epoch") < epoch).agg(F.max_by("n", "epoch")).first()[0] or 0
        numbered = running_count(batch, "event_id", "n").withColumn("n", F.col("n") + F.lit(done))
        numbered.select("event_id", (F.col("n") % 2 == 1).alias("is_playing"), "n").write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")
        now = spark.read.schema("n bigint").parquet(f"{at}/out/epoch={epoch}")
        now.agg(F.coalesce(F.max("n"), F.lit(done)).alias("n")).write.mode("overwrite").parquet(f"{at}/counts/epoch={epoch}")

    commands.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return store.open_table(spark, f"{at}/out", "event_id bigint, is_playing boolean, epoch bigint").select("event_id", "is_playing")


def status_stream(spark: SparkSession, path: str) -> DataFrame:
    """The last value of each status field; each micro-batch writes the whole, small state as a new snapshot."""
    at = shared_folder(spark)
    patches = event_stream(spark, path).select(F.col("event_type").alias("field"), F.col("event_id").alias("seq"), patch_value().alias("value"))
    last = patches.groupBy("field").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("field", "v.value")

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    last.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema("field string, value double, epoch bigint").parquet(f"{at}/out")
    newest = every.agg(F.max("epoch")).first()[0]
    return every.where(F.col("epoch") == newest).select("field", "value")


def status_periodic(spark: SparkSession, path: str, period: str = "1 second") -> DataFrame:
    """The last status written at each tick of the clock; ``latest`` reads it on demand, as a new subscriber does."""
    at = shared_folder(spark)
    patches = event_stream(spark, path).select(F.col("event_type").alias("field"), F.col("event_id").alias("seq"), patch_value().alias("value"))
    last = patches.groupBy("field").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("field", "v.value")
    stop = subscribe(last, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}"), f"{at}/state", mode="complete", period=period)
    stop()
    return latest(spark, f"{at}/out", "field string, value double")


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest snapshot of a state that is written whole in each epoch."""
    every = spark.read.schema(f"{schema}, epoch bigint").parquet(path)
    newest = every.agg(F.max("epoch")).first()[0]
    return every.where(F.col("epoch") == newest).drop("epoch")


def subscribe(df: DataFrame, each, state: str, *, mode: str = "append", period: str = "1 second"):
    """Start a query that gives every micro-batch to ``each(batch, epoch)``; the function that is returned ends it once it has read what is there.

    Opening and closing a source is starting and stopping its query; timers of the caller need none.
    """
    query = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", state).trigger(processingTime=period).start()

    def stop() -> None:
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    return stop


def deliver_stream(spark: SparkSession, paths: list[str], macros: DataFrame, tracks: DataFrame, daws: DataFrame, late: str = "1 hour") -> DataFrame:
    """The messages of the events in some folders, delivered once each."""
    at = shared_folder(spark)
    events = event_stream(spark, paths[0])
    for p in paths[1:]:
        events = events.union(event_stream(spark, p))
    delivery.deliver(events, at, macros, tracks, daws, horizon=late)
    sent = delivery.delivered(spark, at).where("route = 'message'")
    return sent.select(F.col("seq").alias("event_id"), "action_pos", "macro_name", "daw", "track", "track_index", "address", "value")


def dead_letter_stream(spark: SparkSession, path: str, macros: DataFrame, tracks: DataFrame, daws: DataFrame) -> DataFrame:
    """What the stream could not send: micro-batches are routed in one pass and written once, by route."""
    at = shared_folder(spark)

    def each(batch: DataFrame, epoch: int) -> None:
        rows = lookup.routed(batch.select(*model.event_columns()), macros, tracks, daws)
        rows.write.mode("overwrite").partitionBy("route").parquet(f"{at}/out/epoch={epoch}")

    event_stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = store.open_table(spark, f"{at}/out", "seq bigint, action_pos int, detail string, route string")
    return rows.where("route not in ('message', 'echo')").select("seq", "action_pos", F.col("route").alias("reason"), "detail")


def shuffle_stream(tracks: DataFrame, order: list[str], at: str, seed: int, period: str = "5 seconds"):
    """The running query that writes the tracks in a new order at each tick, under the tick's epoch.  Ticks need no input; an epoch that is run again gives the same order."""
    spark = tracks.sparkSession

    def each(_: DataFrame, epoch: int) -> None:
        shuffled(tracks, order, seed, epoch).write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(processingTime=period).start()


def patch_value():
    """A status patch's value; some patches set null."""
    return F.when(F.col("event_id") % 10 != 0, F.col("value"))
