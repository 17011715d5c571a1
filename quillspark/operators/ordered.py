"""Operators that depend on order: samples, splits, first and last rows, segments, rolling sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order, by one aggregation with partial minima: a hot key is a row a task."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(first).select("_row.*")


def head(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= n)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with its position (from 0) in the order of a column of distinct values, and the number of rows.

    Ranges are written with their numbers, sorted on their own and shifted by the counts of those before, so that no task
    sorts all.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, order).withColumn("_bucket", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n"))
    total = counts.agg(F.sum("_n").alias("total"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    out = rows.withColumn("_row", inside).join(F.broadcast(before), "_bucket").withColumn("position", F.col("_before") + F.col("_row") - 1)
    return out.join(F.broadcast(total)).drop("_bucket", "_row", "_n", "_before")


def systematic(df: DataFrame, order: str, n: int) -> DataFrame:
    """The rows at positions floor(i * N / n), i < n."""
    rows = numbered(df, order)
    i = F.ceil(F.col("position") * n / F.col("total"))
    return rows.where((i < n) & (F.floor(i * F.col("total") / n) == F.col("position")))


def every_fifth(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Split "val" for every fifth row of groups with five or more, else "dev"."""
    w = Window.partitionBy(*keys)
    nth, n = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w)
    return df.withColumn("split", F.when((nth % 5 == 0) & (n >= 5), "val").otherwise("dev"))


def round_robin(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows, one of each group in turn."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", nth).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Of each stratum its share of n rows, one at least; rows are taken in the order of a salted hash of the key."""
    order = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size")).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_total"))))
    rows = df.withColumn("_order", order).withColumn("_nth", F.row_number().over(Window.partitionBy(stratum).orderBy("_order")))
    quota = F.greatest(F.lit(1), F.floor(F.col("_size") * n / F.col("_total")))
    return rows.join(F.broadcast(sizes), stratum).where(F.col("_nth") <= quota).drop("_order", "_nth", "_size", "_total")


def quota(df: DataFrame, key: str, strata: list[tuple[str, Column, int]], n: int) -> DataFrame:
    """Up to a quota of rows for each condition by key, each row once (under the first), filled up to n by key."""
    first = None
    for i, (name, condition, most) in enumerate(strata):
        part = df.where(condition).orderBy(key).limit(most).withColumn("stratum", F.lit(name)).withColumn("_i", F.lit(i))
        first = part if first is None else first.union(part)
    first = keep_first(first, [key], ["_i"])
    fill = df.join(first.select(key), key, "left_anti").orderBy(key).limit(n).withColumn("stratum", F.lit("fill")).withColumn("_i", F.lit(len(strata)))
    return first.union(fill).orderBy("_i", key).limit(n).drop("_i")


def copies(df: DataFrame, signature: str, position: str, is_reference: Column) -> DataFrame:
    """df without reference rows whose signature a primary row had earlier; primary rows all stay."""
    first = df.where(~is_reference).groupBy(F.col(signature).alias("_signature")).agg(F.min(position).alias("_first"))
    again = (F.col(signature) == F.col("_signature")) & (F.col("_first") <= F.col(position)) & is_reference
    return df.join(first, again, "left_anti")


def fill_forward(df: DataFrame, keys: list[str], order: str, value: Column) -> Column:
    return F.last(value, True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def segments(lines: DataFrame, key: str, order: str, begins: Column) -> DataFrame:
    """Lines joined into records, each from a line where begins holds to the next; lines before the first are left."""
    number = F.sum(begins.cast("int")).over(Window.partitionBy(key).orderBy(order))
    rows = lines.withColumn("record", number).where("record > 0")
    parts = F.array_sort(F.collect_list(F.struct(order, "line")))
    return rows.groupBy(key, "record").agg(F.array_join(F.transform(parts, lambda p: p["line"]), " ").alias("text"), F.count(F.lit(1)).alias("lines"))


def rolling(df: DataFrame, key: str, seconds: Column, value: str, width: int = 60) -> DataFrame:
    """Sum and count of the last `width` seconds (the far end excluded), and the gap to the row before."""
    w = Window.partitionBy(key).orderBy(F.col("_s"))
    span = w.rangeBetween(-(width - 1), 0)
    return df.withColumn("_s", seconds).withColumn("rolling_sum", F.sum(value).over(span)).withColumn("rolling_count", F.count(F.lit(1)).over(span)).withColumn("gap", F.col("_s") - F.lag("_s").over(w)).drop("_s")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the right value of the latest time that is not after its own, by one sort of both sides."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(key, time, F.col(value).alias("_value"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", True).over(w)).where("_side = 1").drop("_side", "_value")


def range_join(points: DataFrame, spans: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points with the spans lo <= point < hi that hold them; both meet in buckets of a width."""
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(s, "_bucket").where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_bucket")


def first_rows(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n rows in the order in which they came, which a column must tell."""
    return df.orderBy(ordinal).limit(n)


#: What begins a numbered record, and lines that belong to none. Fixed values.
NUMBERED, NOTES = r"^(\d+)\.?\s+(.*)$", r"(?i)^(note|with the office|notice of|paracetamol)"


def numbered_records(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Records of lines (key, order, line): each begins with its number and goes on to the next; notes and blank lines are
    left out, and so is what stands before the first number. Returns key, record, number, text."""
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    begins = F.col("line").rlike(NUMBERED)
    number = F.sum(begins.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("line", line).where("line <> ''").withColumn("record", number).where((F.col("record") > 0) & (begins | ~F.col("line").rlike(NOTES)))
    value = F.struct(order, F.when(begins, F.regexp_extract("line", NUMBERED, 2)).otherwise(F.col("line")).alias("line"))
    parts = F.array_sort(F.collect_list(value))
    out = rows.groupBy(key, "record").agg(F.max(F.when(begins, F.regexp_extract("line", NUMBERED, 1))).alias("number"), F.trim(F.array_join(F.transform(parts, lambda p: p["line"]), " ")).alias("text"))
    return out.where("text <> ''")
