"""What becomes of traces: collapse, union, reciprocal rank fusion, and what branches have in common.

A trace has mention_id, branch, candidate_id, score, rank; other columns are named where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion, and candidates that a mention keeps. Fixed values.
RRF_K, TOP_K = 60, 20


def _cells(column: str) -> Column:
    """The sorted distinct parts of all cells of a column, which hold texts joined by bars."""
    parts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(F.col(column), r"\|")))))
    return F.array_join(F.filter(parts, lambda x: x != ""), "|")


def collapse(trace: DataFrame, aliases: str = "alias", most: int = 12, cells: tuple[str, ...] = ()) -> DataFrame:
    """One row for each mention, branch and candidate: the best rank (ties: the higher score), the sorted distinct
    aliases (the first `most`), and the number of hits. Ranks are not renumbered. cells: columns of ids joined by bars,
    which are taken apart and joined anew."""
    best = F.min(F.struct("rank", (-F.col("score")).alias("minus_score"))).alias("best")
    names = F.slice(F.array_sort(F.collect_set(aliases)), 1, most)
    out = trace.groupBy("mention_id", "branch", "candidate_id").agg(best, F.array_join(names, " || ").alias("aliases"), F.count(F.lit(1)).alias("hits"), *(_cells(c).alias(c) for c in cells))
    return out.select("mention_id", "branch", "candidate_id", F.col("best.rank").alias("rank"), (-F.col("best.minus_score")).alias("score"), "aliases", "hits", *cells)


def union(trace: DataFrame) -> DataFrame:
    """One row for each mention and candidate with the sorted branches that found it and their number."""
    return trace.groupBy("mention_id", "candidate_id").agg(F.array_join(F.array_sort(F.collect_set("branch")), "|").alias("branches"), F.count_distinct("branch").alias("branch_count"), F.min("rank").alias("best_rank"))


def described_union(trace: DataFrame) -> DataFrame:
    """As union, with the name and kind of the best-ranked row (ties: by branch, name, kind) and the sorted states."""
    first = F.min(F.struct("rank", "branch", "name", "kind")).alias("first")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), "|")
    out = trace.groupBy("mention_id", "candidate_id").agg(first, joined("branch").alias("branches"), F.count_distinct("branch").alias("branch_count"), joined("state").alias("states"))
    return out.select("mention_id", "candidate_id", F.col("first.name").alias("name"), F.col("first.kind").alias("kind"), "branches", "branch_count", "states")


def reciprocal_rank(trace: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, top: int = TOP_K) -> DataFrame:
    """The sum over branches of weight / (k + rank), and its parts by branch; the top candidates of each mention, ties to
    the smaller id. A branch names a candidate once for a mention, as after collapse."""
    weight = F.lit(1.0)
    for branch, w in (weights or {}).items():
        weight = F.when(F.col("branch") == branch, F.lit(float(w))).otherwise(weight)
    fused = trace.groupBy("mention_id", "candidate_id").agg(F.sum(weight / (k + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), F.count_distinct("branch").alias("branch_count"), F.array_join(F.array_sort(F.collect_set("branch")), "|").alias("branches"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", (weight / (k + F.col("rank"))).alias("part"))))).alias("components"))
    order = Window.partitionBy("mention_id").orderBy(F.desc(F.round("rrf", 9)), "candidate_id")
    return fused.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top)


def branch_overlap(trace: DataFrame) -> DataFrame:
    """For each pair of branches the candidates that both found, over all that either found, summed over mentions.

    Pairs are made per candidate, whose branches are few, and never per mention.
    """
    pairs = trace.select("mention_id", "candidate_id", "branch").distinct()
    sizes = pairs.groupBy("branch").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.alias("x").join(pairs.alias("y"), (F.col("x.mention_id") == F.col("y.mention_id")) & (F.col("x.candidate_id") == F.col("y.candidate_id")) & (F.col("x.branch") < F.col("y.branch")))
    both = both.groupBy(F.col("x.branch").alias("a"), F.col("y.branch").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    names = sizes.select(F.col("branch").alias("a"), F.col("size").alias("size_a")).join(F.broadcast(sizes.select(F.col("branch").alias("b"), F.col("size").alias("size_b"))), F.col("a") < F.col("b"))
    out = names.join(both, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select("a", "b", "common", (F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))).alias("jaccard"))


def median_overlap(trace: DataFrame) -> DataFrame:
    """For each pair of branches the median over all mentions of how many candidates both found."""
    pairs = trace.where("candidate_id is not null").select("mention_id", "candidate_id", "branch").distinct()
    both = pairs.alias("x").join(pairs.alias("y"), (F.col("x.mention_id") == F.col("y.mention_id")) & (F.col("x.candidate_id") == F.col("y.candidate_id")) & (F.col("x.branch") < F.col("y.branch")))
    counts = both.groupBy(F.col("x.mention_id").alias("mention_id"), F.col("x.branch").alias("a"), F.col("y.branch").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    names = F.broadcast(trace.select("branch").distinct())  # as many rows as branches
    every = trace.select("mention_id").distinct().join(names.withColumnRenamed("branch", "a")).join(names.withColumnRenamed("branch", "b"), F.col("a") < F.col("b"))
    return every.join(counts, ["mention_id", "a", "b"], "left").groupBy("a", "b").agg(F.median(F.coalesce("n", F.lit(0))).alias("median_common"))


def branch_status(calls: DataFrame) -> DataFrame:
    """Per branch the mentions by status (the first one of each mention and branch counts), rates and the median of
    candidates where it succeeded. calls: mention_id, branch, seq, status, candidates, and latency if its median is wanted."""
    timed = ["latency"] if "latency" in calls.columns else []
    first = calls.groupBy("mention_id", "branch").agg(F.min_by("status", "seq").alias("status"), *(F.min_by(c, "seq").alias(c) for c in ["candidates", *timed]))
    of = lambda s: F.count_if(F.col("status") == s)
    return first.groupBy("branch").agg(
        F.count(F.lit(1)).alias("mentions"),
        of("SUCCESS").alias("success"),
        of("EMPTY").alias("empty"),
        of("FAILED").alias("failed"),
        of("UNAVAILABLE").alias("unavailable"),
        F.round(of("SUCCESS") / F.count(F.lit(1)), 6).alias("success_rate"),
        F.median(F.when(F.col("status") == "SUCCESS", F.col("candidates"))).alias("median_candidates"),
        *(F.median(c).alias(f"median_{c}") for c in timed),
    )


def namespace_audit(trace: DataFrame) -> DataFrame:
    """Rows, distinct candidates and the first five ids (by value) of each branch and id prefix."""
    prefix = F.substring_index("candidate_id", "_", 1)
    counted = trace.groupBy("branch", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("candidate_id").alias("candidates"))
    nth = F.row_number().over(Window.partitionBy("branch", "prefix").orderBy("candidate_id"))
    few = trace.select("branch", prefix.alias("prefix"), "candidate_id").distinct().withColumn("nth", nth).where("nth <= 5")
    return counted.join(few.groupBy("branch", "prefix").agg(F.array_join(F.array_sort(F.collect_list("candidate_id")), "|").alias("examples")), ["branch", "prefix"])


def splice(trace: DataFrame, branch: str, replacement: DataFrame) -> DataFrame:
    """The trace with one branch recomputed."""
    return trace.where(F.col("branch") != branch).unionByName(replacement)


def overlay(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, each replaced by new's row of the same key where there is one."""
    fresh = new.select(*(F.col(c).alias(f"new_{c}") for c in new.columns), F.lit(True).alias("replaced"))
    joined = old.join(fresh, F.col(key) == F.col(f"new_{key}"), "left")
    return joined.select(*(F.when(F.col("replaced"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns and c != key else F.col(c) for c in old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with new's rows in place of those of the same key, and in addition where the key is new.

    order: a column of new that tells which of several rows of one key is the latest; it isn't returned. Without it the
    largest row counts, so that the result doesn't hang on the order of rows.
    """
    row = F.struct(*old.columns)
    latest = F.max_by(row, order) if order else F.max(row)
    new = new.groupBy(F.col(key).alias("_key")).agg(latest.alias("_row")).select("_row.*")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def union_size(trace: DataFrame) -> DataFrame:
    """The median number of distinct candidates that mentions have, as one row."""
    return trace.groupBy("mention_id").agg(F.count_distinct("candidate_id").alias("n")).agg(F.median("n").alias("median_candidates"))


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", one_left: bool = True, one_right: bool = True) -> DataFrame:
    """A join whose sides must have a key once where it is said so; else it is refused, with a key that repeats."""
    for name, df, once in (("left", left, one_left), ("right", right, one_right)):
        again = df.groupBy(key).count().where("count > 1").limit(1).collect() if once else []
        if again:
            raise ValueError(f"{key} {again[0][0]!r} repeats on the {name} side")
    return left.join(right, key, how)
