"""Sinks: CSV with all columns, Parquet, JSON, tables and views."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(parts: list[DataFrame], path: str) -> None:
    """Frames of different columns as one CSV table with the columns of all."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("overwrite").option("header", True).csv(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet; with partition columns only the partitions that df has are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_rows(df: DataFrame, path: str) -> None:
    """JSON lines with columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def summary(df: DataFrame) -> str:
    """One row of figures as JSON with sorted keys."""
    return json.dumps(df.first().asDict(), sort_keys=True, default=str)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of all columns: equal before and after if nothing changed."""
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest"))


def tables(spark: SparkSession, frames: dict[str, DataFrame], views: dict[str, str] | None = None) -> None:
    """Frames as tables of the session's catalog, each replaced whole, and views over them by their SQL."""
    for name, df in frames.items():
        df.write.mode("overwrite").saveAsTable(name)
    for name, sql in (views or {}).items():
        spark.sql(sql).createOrReplaceTempView(name)


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A report table of so many rows at most as Markdown."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in df.limit(rows).collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def latex(df: DataFrame, caption: str, rows: int = 1000) -> str:
    """A report table of so many rows at most as a LaTeX table."""
    special = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"})
    cell = lambda v: "" if v is None else str(v).translate(special)
    body = [" & ".join(map(cell, r)) + r" \\" for r in (df.columns, *df.limit(rows).collect())]
    return "\n".join([r"\begin{table}", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", body[0], r"\hline", *body[1:], r"\end{tabular}", r"\end{table}"])


def merged(defaults: dict, given: dict) -> dict:
    """Settings with defaults, level by level."""
    out = dict(defaults)
    for k, v in given.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
