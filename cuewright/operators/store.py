"""Tables that are seeded, appended to and written whole."""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared_folder import shared_folder
from .scan import RANGE, Ranges


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows, and new ones whose key is not there; of new rows with one key the first by ``order``.  A null key never collides."""
    keyed = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
    fresh = keyed.join(existing.select(key), key, "left_anti").select(*existing.columns)
    return existing.unionByName(fresh).unionByName(new.where(F.col(key).isNull()).select(*existing.columns))


def insert_unique(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows, and the new ones that a table with several unique keys takes, offered one by one in ``order``.

    A row is refused if an existing row or an accepted earlier one has one of its keys; a refused row holds no key, so
    it may free another for a later row.  Each round accepts the rows that come first for all of their keys among those
    undecided and refuses the rest of their keys: the first row undecided is always settled, and rows that
    share no key are settled at once.  Rounds are as many as the longest chain of rows that wait for each other.
    ``order`` is unique; null keys never collide.
    """
    spark, at = new.sparkSession, shared_folder(new.sparkSession)

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    for k in keys:
        new = new.join(existing.select(k), k, "left_anti")
    undecided, taken, rounds = save(new.select(*existing.columns, order), "new"), existing, 0
    while not undecided.isEmpty():
        marked, first = undecided, F.lit(True)
        for i, k in enumerate(keys):
            least = undecided.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_least{i}"))
            marked = marked.join(least, k, "left")
            first = first & F.coalesce(F.col(f"_least{i}") == F.col(order), F.lit(True))
        marked = save(marked.withColumn("_first", first), f"marked{rounds}")
        accepted = marked.where("_first").select(*existing.columns)
        rest = marked.where("not _first").select(*existing.columns, order)
        for k in keys:
            rest = rest.join(accepted.select(k), k, "left_anti")
        undecided, taken, rounds = save(rest, f"rest{rounds}"), taken.unionByName(accepted), rounds + 1
    return taken


def with_ids(existing: DataFrame, new: DataFrame, id: str, order: str) -> DataFrame:
    """New rows with ids: their own where they have one, else one more than the greatest id so far, in ``order``.

    An explicit id lifts all later ones.  After row t the greatest id is the number of rows without one up to t plus the greatest of the table's
    own and of (explicit id - rows without one before it), so two prefix folds over ranges give every id.
    """
    top = existing.agg(F.max(id)).first()[0] or 0
    if id not in new.columns:
        new = new.withColumn(id, F.lit(None).cast("bigint"))
    r, none = Ranges(new, [], [order]), F.col(id).isNull()
    rows = r.fold(r.rows, "_given", "sum", none.cast("bigint"))
    rows = r.fold(rows, "_lift", "max", F.when(~none, F.col(id) - F.col("_given")))
    return rows.withColumn(id, F.coalesce(F.col(id), F.col("_given") + F.greatest(F.lit(top).cast("bigint"), F.col("_lift")))).drop(RANGE, "_given", "_lift")


def insert_with_ids(existing: DataFrame, new: DataFrame, id: str, order: str) -> DataFrame:
    """Existing rows and new ones, with ids given where there are none; an explicit id that is taken is refused."""
    return insert_or_ignore(existing, with_ids(existing, new, id, order), id, order)


def seed_if_empty(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed rows if it has none."""
    return seed.select(*existing.columns) if existing.isEmpty() else existing


def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path that only Spark needs to reach, or an empty one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Write the whole table over what was there."""
    df.write.mode("overwrite").parquet(path)


def create_table(spark: SparkSession, name: str, schema: str, path: str | None = None) -> None:
    """Create a table where none of that name is; kept at a path, or in the warehouse."""
    spark.sql(f"create table if not exists {name} ({schema}) using parquet" + (f" location '{path}'" if path else ""))


def send(commands: DataFrame, path: str) -> bool:
    """Append commands to a log; a log that cannot be written is no error for the sender, who is told so."""
    try:
        commands.write.mode("append").parquet(path)
    except Exception as failed:  # the sender goes on, whatever the log's store says
        logging.getLogger(__name__).warning("commands were not stored: %s", str(failed).splitlines()[0])
        return False
    return True


def traced(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows; once they are used, the observation says how many there were."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


#: State in RocksDB, whose commits write what changed and not the whole store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
