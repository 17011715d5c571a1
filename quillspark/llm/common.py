"""What the operators of this subpackage share: written tables (stash), hot keys, workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import small_side, work_dir
from ..tables import written as stash

__all__ = ["BATCH_ROWS", "PART_ROWS", "SMALL_ROWS", "bounded_sample", "discard", "hot_keys", "lower_ascii", "release", "ship", "small_side", "split_join", "stash", "table", "work_dir"]

PACKAGE = Path(__file__).resolve().parents[1]
#: Rows of a side that may be broadcast, and rows of one key that one task of a join gets.
SMALL_ROWS, PART_ROWS = 300_000, 1000
#: Rows of an Arrow batch, where the session has Spark's own default: texts are long, and workers hold whole batches.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame | None) -> None:
    """Deletes what stash wrote for df, once nothing reads it any more."""
    if df is None:
        return
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """At most n of df's rows (there are `rows`): those with the smallest hashes of a key.

    A threshold on the hash leaves about a fifth more than n, so that tasks send the driver only that.
    """
    share = min(1.0, (1.2 * n + 100) / max(rows, 1))
    near = df if share >= 1 else df.where(F.shiftrightunsigned(F.xxhash64(key), 11) < int(share * 2**53))
    return near.orderBy(F.xxhash64(key), *df.columns).limit(n)


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """Keys with more than PART_ROWS rows in df and how many parts they make, as a written table of few rows; None if
    there is none, as in most tables."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > PART_ROWS) & F.col(key).isNotNull())
    if not n.limit(1).count():
        return None
    return stash(n.select(key, F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")).coalesce(8), "hot")


def split_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each key; hot: hot_keys of many.

    The rows of a hot key are dealt by turns to as many parts as it has, each part with its own copy of one's row, so
    that no key's rows meet in one task. many is a written table, for turns to be the same when a task runs again.
    """
    if hot is None:
        return many.join(one, key, how)
    hot = small_side(hot, SMALL_ROWS)
    many = many.withColumn("turn", F.monotonically_increasing_id()).join(hot, key, "left").withColumn("part", F.pmod("turn", F.coalesce("parts", F.lit(1))).cast("int")).drop("turn", "parts")
    one = one.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return many.join(one, [key, "part"], how).drop("part")


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def release() -> None:
    """Gives a Python worker's unused memory back, at the end of a partition: idle workers stay for the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they don't find it by themselves; keeps their batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    top = str(PACKAGE.parent)
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top in on_path or os.path.realpath(os.getcwd()) == top or getattr(spark.sparkContext, "_quillspark_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._quillspark_shipped = True
