"""What the operators share: tables in the cluster's shared folder, and components of a graph."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_cuewright_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="cuewright-")) / "cuewright.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._cuewright_shipped = True


#: Texts go to Python in Arrow batches of about so many bytes, so a worker's memory does not grow with the rows of a partition.
BATCH_BYTES = "2m"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Written tables in the folder of ``spark.checkpoint.dir``; they cut lineage and survive lost executors.

    Where that setting is missing on a local master (tests) a folder of this process is
    made and set as the checkpoint folder; on a cluster that is an error, since executors
    would write to disks of their own.  Arrow batches are bounded by bytes unless the session says otherwise.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ship(spark)
        if spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="cuewright-")
            spark.sparkContext.setCheckpointDir(base)
        self.base = f"{base}/cuewright-{uuid.uuid4().hex}"
        self.count = 0

    def owns(self, df: DataFrame) -> DataFrame:
        """The same table, which knows whose tables it reads."""
        df._scratch = self
        return df

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bytes(self, saved: DataFrame) -> int:
        """The size of a saved table's files."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(saved._scratch_path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for t in tables:
            self._delete(t._scratch_path)

    def clear(self) -> None:
        """Delete all of them, once what was made from them is written elsewhere."""
        self._delete(self.base)


#: A side of a join is broadcast when its files are no larger; beyond that the join is shuffled.
SMALL_BYTES = 4 << 20


def small_side(scratch: Scratch, saved: DataFrame) -> DataFrame:
    """A saved table, with a broadcast hint only if its measured size is under the bound."""
    return F.broadcast(saved) if scratch.bytes(saved) <= SMALL_BYTES else saved


#: A filter of ids has so many bits, at most 131,072 words of 64, whatever the number of ids: with more ids more rows pass for nothing, and none is lost.
FILTER_BITS = 1 << 23


def sifted(scratch: Scratch, rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (long) may be among the ids, which have a column of that name, and those whose key is not.

    Bits of the ids' hashes are broadcast, so rows with long texts that a join would not match are told where they
    lie; only the first table need be shuffled to meet the ids, at any size.  A null key is never among the ids and may be in either.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).alias("_place")
    bit = "shiftleft(1L, cast(_place & 63 as int))"
    words = scratch.save(ids.select(place).groupBy(F.expr("_place div 64").alias("_word")).agg(F.expr(f"bit_or({bit})").alias("_bits")))
    told = rows.select("*", place).join(F.broadcast(words), F.expr("_place div 64 = _word"), "left")
    may = F.coalesce(F.expr(f"_bits & {bit} <> 0"), F.lit(False))
    return told.where(may).select(*rows.columns), told.where(~may).select(*rows.columns)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long): one row (node, comp) for each node, comp the smallest node.

    Alternates large-star and small-star steps, each an aggregation with
    partial sums and a join that can be split for hot nodes, until the edges
    are a star around each smallest node.  Links stay in tables throughout.
    """

    def tell(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = tell(now)
    while size[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        later = scratch.save(small)
        scratch.drop(now)
        now, before, size = later, size, tell(later)
        if size == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b"), F.col("b")).distinct())
