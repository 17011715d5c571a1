"""Candidate retrieval. Every branch turns mentions (mention_id, text) and a catalog (candidate_id, name) into a trace:
mention_id, branch, candidate_id, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..sources.writers import fingerprint
from ..tables import is_small, small_side, written

#: Distinct texts of a block's part, and query vectors of a block.
BLOCK, QUERY_BLOCK = 4096, 1024


def ranked(hits: DataFrame, branch: str, limit: int) -> DataFrame:
    """The best hits of each mention by rounded score, ties to the smaller candidate_id.

    Limits run before and after the shuffle (window group limit), so a popular mention sends limit rows a task.
    """
    order = Window.partitionBy("mention_id").orderBy(F.desc(F.round("score", 9)), "candidate_id")
    rows = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return rows.select("mention_id", F.lit(branch).alias("branch"), "candidate_id", "score", "rank")


def ranked_all(hits: DataFrame, branch: str) -> DataFrame:
    """All hits of each mention with their ranks, in the order of ranked.

    Hits are dealt by ranges of mention and place, so that a popular mention lies in several; each range is numbered on
    its own and shifted by what the mention has in those before.
    """
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(hits.withColumn("place", -F.round("score", 9)), "hits")
    rows = written(rows.repartitionByRange(parts, "mention_id", "place", "candidate_id").withColumn("range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("mention_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("mention_id", "range", (F.sum("n").over(Window.partitionBy("mention_id").orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("mention_id", "range").orderBy("place", "candidate_id"))
    out = rows.withColumn("nth", inside).join(before, ["mention_id", "range"])
    return out.select("mention_id", F.lit(branch).alias("branch"), "candidate_id", "score", (F.col("before") + F.col("nth")).cast("int").alias("rank"))


def exact(mentions: DataFrame, catalog: DataFrame, limit: int = 75, ascii_only: bool = False) -> DataFrame:
    """Equal normalized names; a mention asks with its normalized text and with its bare surface."""
    keys = F.array_distinct(F.array(text.normalize_text(F.col("text"), ascii_only), text.query_surface(F.col("text"), ascii_only)))
    probes = mentions.select("mention_id", F.explode(keys).alias("key")).where("key <> ''")
    names = catalog.select("candidate_id", text.normalize_text(F.col("name"), ascii_only).alias("key")).where("key <> ''")
    hits = probes.join(names, "key").groupBy("mention_id", "candidate_id").agg(F.lit(1.0).alias("score"))
    return ranked(hits, "exact", limit)


def blocked_fuzzy(mentions: DataFrame, catalog: DataFrame, score: Column, threshold: float, limit: int = 75, tokens: int | None = None, ascii_only: bool = False) -> DataFrame:
    """Pairs that share a token and score threshold or more. Mentions without a token that a name has meet the names
    with their first character.

    score reads columns a and b. tokens: of a name, the first so many ask only (all of them by default). Distinct texts
    are compared once, under the first token they share; a block of many texts is cut into parts, and every pair of
    parts is a group of its own.
    """

    def texts(df: DataFrame, column: str, to: str) -> DataFrame:
        words = F.array_distinct(text.tokens(F.col(column), ascii_only))
        return df.select(text.normalize_text(F.col(column), ascii_only).alias(to), words.alias("words")).where(F.col(to) != "").distinct()

    initial = lambda c: F.array(F.concat(F.lit("^"), F.substring(c, 1, 1)))
    right = texts(catalog, "name", "b").withColumn("words", F.slice("words", 1, tokens) if tokens else F.col("words"))
    left = texts(mentions, "text", "a")
    known = right.select(F.explode("words").alias("word")).distinct()
    met = left.select("a", F.explode("words").alias("word")).join(known, "word", "left_semi").select("a").distinct().withColumn("met", F.lit(True))
    left = left.join(met, "a", "left").select("a", F.when(F.col("met"), F.col("words")).otherwise(initial("a")).alias("asks"))
    right = right.select("b", F.concat("words", initial("b")).alias("has"))
    left, right = left.withColumn("block", F.explode("asks")), right.withColumn("block", F.explode("has"))
    parts = lambda df, n: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    cuts = parts(left, "n_a").join(parts(right, "n_b"), "block")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = left.join(cuts, "block").withColumn("x", own("a", "n_a")).withColumn("y", each("n_b")).select("block", "x", "y", "a", "asks")
    right = right.join(cuts, "block").withColumn("y", own("b", "n_b")).withColumn("x", each("n_a")).select("block", "x", "y", "b", "has")
    once = F.element_at(F.array_intersect("asks", "has"), 1) == F.col("block")
    pairs = left.join(right, ["block", "x", "y"]).where(once).select("a", "b").withColumn("score", score).where(F.col("score") >= threshold)
    asked = mentions.select("mention_id", text.normalize_text(F.col("text"), ascii_only).alias("a"))
    names = catalog.select("candidate_id", text.normalize_text(F.col("name"), ascii_only).alias("b"))
    hits = pairs.join(asked, "a").join(names, "b").select("mention_id", "candidate_id", "score").distinct()
    return ranked(hits, "fuzzy", limit)


def normalized(df: DataFrame, key: str, column: str, ascii_only: bool = False) -> DataFrame:
    """(key, t): normalized texts, written once, for the branches that read them several times. A frame that has t
    already is taken as it is. Tables of a few files are dealt to all cores first."""
    if "t" in df.columns:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    return written(df.select(key, text.normalize_text(F.col(column), ascii_only).alias("t")), "normalized")


def _holds(big: DataFrame, small: DataFrame) -> DataFrame:
    """Pairs (big_id, small_id) with small's text inside big's; both are normalized.

    Words of a small text but its first and last are whole words of each text that holds it. A small text asks with the
    rarest of them; without any it asks with its rarest three characters, or its first one, and only then big texts are
    posted under these too. Words are filtered by what is asked for while big is scanned.
    """
    pieces = lambda t: F.regexp_extract_all(t, F.lit("(?s)(?=(.{3}))"), F.lit(1))
    marked = lambda kind, a: F.transform(F.array_distinct(a), lambda w: F.concat(F.lit(kind), w))
    ends = big.agg(F.max(F.length("big"))).first()[0] or 0
    words = F.split("small", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    keys = F.when(F.size(inner) > 0, marked("w", inner)).when(F.length("small") >= 3, marked("t", pieces(F.col("small")))).otherwise(marked("c", F.array(F.substring("small", 1, 1))))
    small = written(small.where(F.length("small") <= ends).withColumn("keys", keys), "small")
    bounds = small.agg(F.min(F.length("small")).alias("least"), F.max(F.size(inner) == 0).alias("short")).first()
    if bounds["least"] is None:
        return big.select("big_id").join(small.select("small_id").limit(0))
    has = marked("w", F.split("big", " "))
    if bounds["short"]:
        has = F.concat(has, marked("t", pieces(F.col("big"))), marked("c", F.split("big", "")))
    posted = big.where(F.length("big") >= bounds["least"]).select("big_id", "big", F.explode(has).alias("piece"))
    asks = small.select("small_id", "small", F.explode("keys").alias("piece"))
    held = posted.join(small_side(written(asks.select("piece").distinct(), "pieces")), "piece", "left_semi").groupBy("piece").count()
    # A piece that no big text has ends the search for its text: the inner join drops it, as the rarest of all.
    count = asks.select("small_id", "piece").join(held, "piece", "left").select("small_id", "piece", F.coalesce("count", F.lit(0)).alias("n"))
    rarest = count.groupBy("small_id").agg(F.min(F.struct("n", "piece")).alias("r")).where("r.n > 0").select("small_id", F.col("r.piece").alias("piece"))
    rarest = written(rarest.join(small.select("small_id", "small"), "small_id"), "asks")
    if is_small(rarest):
        return posted.join(F.broadcast(rarest), "piece").where(F.col("big").contains(F.col("small"))).select("big_id", "small_id")
    # Else postings go as ids and pieces, and texts come back for what is left.
    pairs = posted.select("big_id", "piece").join(rarest.select("small_id", "piece"), "piece").select("big_id", "small_id")
    return pairs.join(big.select("big_id", "big"), "big_id").join(small.select("small_id", "small"), "small_id").where(F.col("big").contains(F.col("small"))).select("big_id", "small_id")


def contained(mentions: DataFrame, catalog: DataFrame, ascii_only: bool = False) -> DataFrame:
    """All names that contain a mention's text, or are contained in it, both normalized; fusion is what limits them."""
    asked = normalized(mentions, "mention_id", "text", ascii_only).where("t <> ''")
    names = normalized(catalog, "candidate_id", "name", ascii_only).where("t <> ''")
    as_big = lambda df, key: df.select(F.col(key).alias("big_id"), F.col("t").alias("big"))
    as_small = lambda df, key: df.select(F.col(key).alias("small_id"), F.col("t").alias("small"))
    inside = _holds(as_big(names, "candidate_id"), as_small(asked, "mention_id")).select(F.col("small_id").alias("mention_id"), F.col("big_id").alias("candidate_id"))
    around = _holds(as_big(asked, "mention_id"), as_small(names, "candidate_id")).select(F.col("big_id").alias("mention_id"), F.col("small_id").alias("candidate_id"))
    return ranked_all(inside.union(around).distinct().withColumn("score", F.lit(1.0)), "contained")


def corpus_statistics(terms: DataFrame) -> DataFrame:
    """idf of each term from terms (candidate_id, term): ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n = terms.agg(F.count_distinct("candidate_id").alias("n"))
    df = terms.groupBy("term").agg(F.count_distinct("candidate_id").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(mentions: DataFrame, catalog: DataFrame, limit: int = 25, k1: float = 1.5, b: float = 0.75, ascii_only: bool = False, indexed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Okapi BM25. Repeated query terms count as often as they occur.

    Texts are normalized once, and words that no mention has go before anything is shuffled. Postings (a document's id,
    length, term and its count) are written, dealt by document, so that a document's weights are summed where they are
    read. Corpus size and mean length are one row. indexed: what index returned for the catalog, which isn't read then.
    """
    words = text.split_tokens(F.col("t"))
    asked = written(normalized(mentions, "mention_id", "text", ascii_only).select("mention_id", F.explode(words).alias("term")).groupBy("mention_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    terms = written(asked.select("term").distinct(), "terms")
    if indexed:
        postings, lengths = indexed[0].join(small_side(terms), "term", "left_semi"), indexed[1]
    else:
        lengths = normalized(catalog, "candidate_id", "name", ascii_only).select("candidate_id", words.alias("words")).withColumn("length", F.greatest(F.size("words"), F.lit(1)))
        rows = lengths.select("candidate_id", "length", F.explode("words").alias("term")).join(small_side(terms), "term", "left_semi")
        postings = written(rows.repartition("candidate_id").groupBy("candidate_id", "length", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    df = written(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    rows = postings.join(small_side(df), "term").join(F.broadcast(total)).select("candidate_id", "term", weight.alias("w"))
    hits = rows.join(small_side(asked), "term").groupBy("mention_id", "candidate_id").agg(F.sum(F.col("w") * F.col("times")).alias("score"))
    return ranked(hits, "bm25", limit)


def index(catalog: DataFrame, folder: str, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings (candidate_id, length, term, tf) and documents (candidate_id, length) of a catalog, written below a folder
    under the catalog's fingerprint and read from there while the catalog stays the same."""
    spark = catalog.sparkSession
    made = fingerprint(catalog).first()
    path = f"{folder.rstrip('/')}/{made['n']}-{made['digest']}-{int(ascii_only)}"
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/postings/_SUCCESS")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        words = text.tokens(F.col("name"), ascii_only)
        rows = catalog.select("candidate_id", words.alias("words")).withColumn("length", F.greatest(F.size("words"), F.lit(1)))
        rows.select("candidate_id", "length").write.mode("overwrite").parquet(f"{path}/documents")
        rows.select("candidate_id", "length", F.explode("words").alias("term")).repartition("candidate_id").groupBy("candidate_id", "length", "term").agg(F.count(F.lit(1)).alias("tf")).write.mode("overwrite").parquet(f"{path}/postings")
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents")


def fuzzy_scan(mentions: DataFrame, names: DataFrame, score: Column, threshold: float, limit: int = 75, ascii_only: bool = False) -> DataFrame:
    """Every distinct mention text against every distinct name, in blocks: a stated query set against all rows.

    score reads columns a and b. For names that share no token with their mention; blocked_fuzzy is the cheaper way.
    """
    left = written(mentions.select(text.normalize_text(F.col("text"), ascii_only).alias("a")).where("a <> ''").distinct(), "asked")
    n = max(1, -(-left.count() // BLOCK))
    left = left.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(n)).cast("int"))
    right = names.select(text.normalize_text(F.col("name"), ascii_only).alias("b")).where("b <> ''").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = right.join(F.broadcast(left) if n == 1 else left, "block").select("a", "b").withColumn("score", score).where(F.col("score") >= threshold)
    asked = mentions.select("mention_id", text.normalize_text(F.col("text"), ascii_only).alias("a"))
    of = names.select("candidate_id", text.normalize_text(F.col("name"), ascii_only).alias("b"))
    return ranked(pairs.join(asked, "a").join(of, "b").select("mention_id", "candidate_id", "score").distinct(), "scan", limit)


def dense(queries: DataFrame, vectors: DataFrame, limit: int = 25, where: Column | None = None, cosine: bool = False) -> DataFrame:
    """Inner products of query vectors (mention_id, vector) with all vectors (candidate_id, vector), best first.

    A stated query set meets all rows in blocks of queries. where: a condition on mention_id and candidate_id, for
    callers whose ids are of one kind. cosine: vectors count as if they had length 1. Queries are broadcast if they are few; limits run before ranks are shuffled.
    """
    of = (lambda c: similarity.unit(F.col(c))) if cosine else (lambda c: F.transform(c, lambda x: x.cast("double")))
    queries = written(queries.select("mention_id", of("vector").alias("q")), "queries")
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("mention_id"), F.lit(n)).cast("int"))
    rows = vectors.select("candidate_id", of("vector").alias("v")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = rows.join(F.broadcast(blocks) if n == 1 else blocks, "block")
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return ranked((pairs if where is None else pairs.where(where)).select("mention_id", "candidate_id", product.alias("score")), "dense", limit)


def crosswalk(source: DataFrame, direct: DataFrame, names: DataFrame) -> DataFrame:
    """source (id, name, components array) to target: by id, else by exact normalized name, else by a single component."""
    name = text.normalize_text(F.col("name"))
    by_name = names.select(text.normalize_text(F.col("target_name")).alias("key"), F.col("target").alias("by_name")).groupBy("key").agg(F.min("by_name").alias("by_name"))
    single = by_name.select(F.col("key").alias("single_key"), F.col("by_name").alias("by_single"))
    component = F.when(F.size("components") == 1, text.normalize_text(F.element_at("components", 1)))
    rows = source.withColumn("key", name).withColumn("single_key", component).join(direct.select("id", F.col("target").alias("by_id")), "id", "left").join(by_name, "key", "left").join(single, "single_key", "left")
    return rows.select("id", F.coalesce("by_id", "by_name", "by_single").alias("target"))


def per_distinct_text(mentions: DataFrame, branch) -> DataFrame:
    """Runs a branch once for each distinct text and gives its trace to every mention of that text."""
    texts = written(mentions.select("text").distinct().withColumn("mention_id", F.monotonically_increasing_id()), "texts")
    trace = branch(texts).withColumnRenamed("mention_id", "text_id")
    of = texts.select(F.col("mention_id").alias("text_id"), F.col("text").alias("one"))
    return mentions.join(of, mentions["text"].eqNullSafe(of["one"])).select("mention_id", "text_id").join(trace, "text_id").drop("text_id")


__all__ = ["blocked_fuzzy", "bm25", "contained", "corpus_statistics", "crosswalk", "dense", "exact", "fuzzy_scan", "index", "normalized", "per_distinct_text", "ranked", "ranked_all", "similarity"]
