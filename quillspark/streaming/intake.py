"""Incremental intake and rates, as Structured Streaming and as their batch counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, content: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each content once. With an event time, state is dropped once the watermark has passed it."""
    keyed = stream.withColumn("sha", F.sha2(F.col(content).cast("string"), 256))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha"]) if time else keyed.dropDuplicates(["sha"])


def changed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key and content were not processed before. done: key, row_hash."""
    names = sorted(c for c in rows.columns if c != key)
    hashed = rows.withColumn("row_hash", F.sha2(F.to_json(F.struct(*names)), 256))
    return hashed.join(done.select(key, "row_hash"), [key, "row_hash"], "left_anti")


def unfinished(tasks: DataFrame, states: DataFrame, key: str) -> DataFrame:
    return tasks.join(states.where("status = 'SUCCESS'").select(key), key, "left_anti")


def tumbling(stream: DataFrame, time: str, by: str, value: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(time, delay) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(time, delay) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what there is and stops; both paths are shared folders."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def estimated_tokens(images: Column, knowledge_kb: Column, characters: Column) -> Column:
    """Tokens that a call is likely to use, with a fifth on top."""
    return F.floor((images * 10 + knowledge_kb * 0.8 + 500 + characters / 4) * 1.2).cast("long")
