"""The stages of the corpus pipeline: quality rules, MinHash near-dedup, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, small_side, stash, table
from .near_dedup import groups
from .packing import pack
from .quality import quality_verdicts
from .secrets import redact, secret_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Jaccard similarity, in percent, from which the stage links documents; op5's own is 85.
PERCENT = 80


def key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for rows whose doc_id (null-safe) and text key are in dropped, a written table of distinct rows."""
    dropped = small_side(dropped.select(F.col("doc_id").alias("dropped_id"), F.col("text_key").alias("dropped_key")), SMALL_ROWS)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["dropped_id"]) & (key() == dropped["dropped_key"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the trees reject go, each row by its own text."""
    verdicts = quality_verdicts(docs, table(spark, sf_dir, "labels"))
    return without(docs, stash(verdicts.where("not kept").select("doc_id", "text_key").distinct(), "rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more) one document stays: the smallest doc_id (nulls last), then text key.

    Rows without words are in no group and all stay. A chosen row that is repeated stays once.
    """
    found = stash(groups(docs, percent=PERCENT), "groups")
    left = without(docs, stash(found.where("not chosen").select("doc_id", "text_key").distinct(), "duplicates")).select(*COLUMNS)
    repeated = stash(found.where("chosen and n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "repeated")
    if not repeated.limit(1).count():
        return left
    again = small_side(repeated.select(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key")), SMALL_ROWS)
    again = left.withColumn("text_key", key()).join(again, left["doc_id"].eqNullSafe(again["again_id"]) & (F.col("text_key") == again["again_key"]), "left_semi")
    first = Window.partitionBy("doc_id", "text_key").orderBy("lang", "source", "n_chars")
    return without(left, repeated).union(again.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, n_chars follows; documents themselves all stay."""
    found = stash(secret_spans(docs).where(F.size("spans") > 0), "secrets")
    plain = docs.select(*COLUMNS)
    return redact(plain, found).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, with its place in a sequence."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]
#: Tree training and the tokenizer can't be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
