"""Quality of results: precision and recall, intervals, agreement, profiles, macro averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": share(2 * p * r, p + r)}


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval."""
    p, z2 = hits / n, z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (centre - half) / (1 + z2 / n), (centre + half) / (1 + z2 / n)


def dense_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows, percentage and Wilson bounds (percent, 1 digit) of every value of a fixed domain, absent ones included."""
    values = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{column} string, position int")
    counts = F.broadcast(values).join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    low, high = wilson(F.col("n"), F.col("total"))
    pct = lambda c: F.round(100 * c, 1)
    return counts.join(F.broadcast(total)).select(column, "n", pct(F.col("n") / F.col("total")).alias("pct"), pct(low).alias("ci_low"), pct(high).alias("ci_high"))


def group_profile(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Rows, share of all rows, and the rate of each flag for every group."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags))
    return out.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).select(key, "n", (F.col("n") / F.col("total")).alias("share"), *(f"{f}_rate" for f in flags))


def crosstab(df: DataFrame, key: str, status: str, domain: list[str], least: int = 10) -> DataFrame:
    """Counts of each status for groups of least rows or more."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(status) == s).alias(s) for s in domain)).where(F.col("n") >= least)


def coverage(cohorts: dict[str, DataFrame], flags: list[str]) -> DataFrame:
    """One row for each cohort and flag: how many rows have it."""
    out = None
    for name, df in cohorts.items():
        one = df.agg(*(F.count_if(F.col(f)).alias(f) for f in flags)).unpivot([], flags, "metric", "n").select(F.lit(name).alias("cohort"), "metric", "n")
        out = one if out is None else out.union(one)
    return out


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: n, observed and expected agreement, kappa. Everything comes from the crosstab."""
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")).withColumnRenamed(c, "v") for c in ("a", "b"))
    chance = rows.join(columns, "v").agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("products"))
    out = total.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.col("products") / (F.col("n") * F.col("n"))).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def token_scores(pairs: DataFrame, key: str, truth: Column, found: Column) -> DataFrame:
    """Bag-of-token precision, recall and F1 of every pair, and the recall of distinct numeric tokens.

    truth and found are token arrays. Bags meet as counted tokens, aggregated before the shuffle.
    """
    tokens = pairs.select(key, F.explode(truth).alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(pairs.select(key, F.explode(found), F.lit(0), F.lit(1)))
    bags = tokens.groupBy(key, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    number = F.col("t").rlike("^[0-9]+$")
    sums = bags.groupBy(key).agg(F.sum(F.least("x", "y")).alias("common"), F.sum("x").alias("truth"), F.sum("y").alias("found"), F.count_if(number & (F.col("x") > 0)).alias("numbers"), F.count_if(number & (F.col("x") > 0) & (F.col("y") > 0)).alias("numbers_found"))
    p, r = share(F.col("common"), F.col("found")), share(F.col("common"), F.col("truth"))
    return sums.select(key, p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"), share(F.col("numbers_found"), F.col("numbers")).alias("number_recall"))


def macro(scores: DataFrame, category: str, value: str, by: str) -> DataFrame:
    """Mean of category means for each group and overall, in one pass over (group, category) sums."""
    cells = scores.groupBy(by, category).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    levels = cells.withColumn("level", F.explode(F.array(F.col(by), F.lit("ALL"))))
    per = levels.groupBy("level", category).agg((F.sum("s") / F.sum("n")).alias("mean"))
    return per.groupBy(F.col("level").alias(by)).agg(F.avg("mean").alias("macro"))


def long_tail(df: DataFrame, column: str) -> DataFrame:
    """Values by falling frequency. The window sorts distinct values only."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), column)))


def mask_agreement(cells: DataFrame, key: str) -> DataFrame:
    """Recall, precision and intersection over union of masks given by cells with booleans truth and found."""
    both, t, f = (F.count_if(c) for c in (F.col("truth") & F.col("found"), F.col("truth"), F.col("found")))
    either = F.count_if(F.col("truth") | F.col("found"))
    return cells.groupBy(key).agg(share(both, t).alias("recall"), share(both, f).alias("precision"), share(both, either).alias("iou"), (t - both).alias("missed"), (f - both).alias("extra"))


def headline(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted sum, kept within 0 and 1."""
    total = F.lit(0.0)
    for value, weight in parts.values():
        total = total + value * weight
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def readiness(gates: dict[str, Column], df: DataFrame) -> DataFrame:
    """Whether every row passes each gate, and all of them."""
    one = df.agg(*(F.coalesce(F.every(c), F.lit(True)).alias(n) for n, c in gates.items()))
    ready = F.lit(True)
    for n in gates:
        ready = ready & F.col(n)
    return one.withColumn("ready", ready)


def document_rates(documents: DataFrame) -> DataFrame:
    """Rates of documents with hallucinations, gaps, missed, truths, predictions and name_hallucinated columns: shares of
    predictions (a hallucinated name is one more) and of truths, 0 where there are none."""
    predicted = F.col("predictions") + F.col("name_hallucinated").cast("int")
    share = lambda n, of: F.when(of > 0, F.col(n) / F.greatest(F.lit(1), of)).otherwise(0.0)
    return documents.select("document", share("hallucinations", predicted).alias("hallucination_rate"), share("gaps", predicted).alias("gap_rate"), share("missed", F.col("truths")).alias("missing_rate"))


def best_of_roles(rows: DataFrame, roles: dict[str, Column], score: str, key: str) -> DataFrame:
    """For each role (a condition) the row with the highest score, ties to the smallest key; one scan, one row a role."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in roles.items())))
    value = F.struct(F.col(score).alias("score"), *rows.columns)
    tagged = rows.where(F.col(score).isNotNull()).select(F.explode(named).alias("role"), F.struct((-F.col(score)).alias("minus"), F.col(key).alias("key")).alias("place"), value.alias("row"))
    return tagged.groupBy("role").agg(F.min_by("row", "place").alias("row")).select("role", *(F.col(f"row.{c}").alias(c) for c in rows.columns))


def field_counts(pairs: DataFrame, similarity, least: float = 0.7) -> DataFrame:
    """True and false positives and false negatives of documents with found and truth maps, over the keys of both.

    similarity: a function of two text columns, from 0 to 1. Two texts that differ are a false positive and a false
    negative; a key that one side lacks is as one with an empty text.
    """
    keys = F.explode(F.array_union(F.map_keys("found"), F.map_keys("truth")))
    value = lambda side: F.lower(F.trim(F.coalesce(F.try_element_at(side, F.col("key")), F.lit(""))))
    rows = pairs.select("document", keys.alias("key"), "found", "truth").select("document", value("found").alias("p"), value("truth").alias("t"))
    same = (F.col("p") != "") & (F.col("t") != "") & (similarity(F.col("p"), F.col("t")) > least)
    return rows.groupBy("document").agg(F.count_if(same).alias("tp"), F.count_if((F.col("p") != "") & ~same).alias("fp"), F.count_if((F.col("t") != "") & ~same).alias("fn"))


def in_branch_order(trace: DataFrame, branches: list[str]) -> DataFrame:
    """The trace with place, the order of its rows: by mention, then by the stated order of branches, rank and id."""
    place = F.array_position(F.array(*map(F.lit, branches)), F.col("branch"))
    return trace.withColumn("branch_order", F.when(place == 0, len(branches) + 1).otherwise(place)).orderBy("mention_id", "branch_order", "rank", "candidate_id")


def study_summary(masks: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: masks (layout, area, attributable boolean), the largest layout's share, the median area of attributable
    masks, how many aren't, and the medians of the metrics' columns."""
    sizes = masks.groupBy("layout").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("masks"), F.count(F.lit(1)).alias("layouts"), (F.max("n") / F.sum("n")).alias("common_share"))
    areas = masks.agg(F.median(F.when(F.col("attributable"), F.col("area"))).alias("median_area"), F.count_if(~F.col("attributable")).alias("uncertain"))
    medians = metrics.agg(*(F.median(c).alias(f"median_{c}") for c in metrics.columns))
    return sizes.join(F.broadcast(areas)).join(F.broadcast(medians))


def surface_category(text: Column, hits: Column, best_exact: Column, exact_ingredient: Column) -> Column:
    """Which of seven kinds a surface is, the first that fits. text: normalized; hits: candidates that it has; best_exact:
    the highest score of its exact branch (null without hits there); exact_ingredient: whether that names an ingredient."""
    return (
        F.when(F.coalesce(hits, F.lit(0)) == 0, "low_resource_unresolved")
        .when(text.rlike(r"\d+(\.\d+)?\s*(mg|mcg|g|ml|iu|%)"), "strength_bearing")
        .when((text.contains("+") | text.contains("/") | text.contains("with")) & (F.size(F.split(text, " ")) > 1), "fdc_looking")
        .when((F.length(text) <= 5) | text.rlike("^(tab|cap|syp) "), "abbreviation")
        .when(best_exact >= 0.999, F.when(exact_ingredient, "generic_name").otherwise("exact_looking_brand"))
        .when(best_exact.isNotNull(), "misspelling_or_variant")
        .otherwise("generic_name")
    )


def mask_routing(recall: Column, least: float = 0.72) -> Column:
    return F.when(recall < least, "NEEDS_REVIEW").otherwise("SUCCESS")


def scored(alignments: DataFrame, review: tuple[str, ...] = ("gap", "review")) -> dict[str, DataFrame]:
    """The report tables of aligned fields (document, category, status TP, FP or FN, similarity, kind): by document, by
    field, the alignment itself, errors, the queue for review, and one summary row of macro means over documents."""
    count = lambda s: F.count_if(F.col("status") == s)
    tally = [count("TP").alias("tp"), count("FP").alias("fp"), count("FN").alias("fn")]
    rated = lambda df: df.withColumns(precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))
    documents = rated(alignments.groupBy("document").agg(*tally, F.avg("similarity").alias("similarity")))
    return {
        "documents": documents,
        "fields": rated(alignments.groupBy("category").agg(*tally)),
        "alignment": alignments,
        "errors": alignments.where("status <> 'TP'"),
        "review": alignments.where(F.col("kind").isin(*review)),
        "summary": documents.agg(F.count(F.lit(1)).alias("documents"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "similarity"))),
    }
