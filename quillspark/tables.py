"""Tables between the steps of an operator: the shared work folder, written tables, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes about, of a side that may be broadcast.
SMALL_ROWS, SMALL_BYTES = 300_000, 32 << 20


_made: dict[str, list[str]] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing a local session gets a folder of its own; a cluster session is refused, for a
    machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: computed once, and no executor's loss undoes it."""
    spark = df.sparkSession
    top = f"{work_dir(spark)}/written-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(top)
    schema = df.schema
    df.write.parquet(f"{top}/{name}")
    return spark.read.schema(schema).parquet(f"{top}/{name}")


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this session has written so far, and says how many: for jobs whose results are stored.

    Results that aren't stored yet may still read them.
    """
    made = _made.pop(spark.sparkContext.applicationId, [])
    for top in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def small_side(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """df, marked for broadcast only if a count shows it to be small in rows and bytes; else Spark shuffles it.

    df is read twice, so it should be a written table.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    width = F.lit(8 * len(df.columns)) + sum((F.coalesce(F.length(c).cast("long"), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")), F.lit(0))
    found = df.limit(rows + 1).select(width.alias("width")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("width"), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size
