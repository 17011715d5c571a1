"""Scans: string tables, tolerant JSON, triples, HTML rows and links, text lines, folders of documents, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV table with every column as text and nulls as empty texts; unread columns are pruned from the scan."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return (df.select(*columns) if columns else df).na.fill("")


def in_order(df: DataFrame, name: str) -> DataFrame:
    """A Parquet table as read, with a column that grows in the order of its rows: files by path, then places in them."""
    place = F.col("_metadata.row_index")
    if len(df.inputFiles()) < 2:
        return df.withColumn(name, place)
    path = F.col("_metadata.file_path").alias("_path")
    files = df.select(path).distinct().select("_path", F.row_number().over(Window.orderBy("_path")).cast("long").alias("_file"))
    rows = df.select("*", path, place.alias("_place")).join(F.broadcast(files), "_path")
    return rows.select(*df.columns, (F.shiftleft("_file", 40) + F.col("_place")).alias(name))


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one in a file or an array of them; broken ones keep their text in _corrupt_record."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("file", F.col("_metadata.file_path"))


def triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON lines with head, relation and tail."""
    edges = spark.read.schema("head string, relation string, tail string").json(path)
    return graph(edges)


def graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = edges.select(F.col("head").alias("node")).union(edges.select("tail")).where("node is not null").distinct()
    return nodes, edges.where("head is not null and tail is not null")


def lines(df: DataFrame, key: str, text: str = "text", matching: str | None = None) -> DataFrame:
    """Numbered lines (from 1) of a text column, if asked for only those that match."""
    out = df.select(key, F.posexplode(F.split(text, "\n"))).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), F.col("col").alias("line"))
    return out.where(F.col("line").rlike(matching)) if matching else out


def links(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Links of pages in order: position (from 1), target (quoted either way, or not at all), and text without markup."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)[^>]*>.*?</a>"), F.lit(0))
    rows = df.select(key, F.posexplode(anchors))
    label = F.trim(F.regexp_replace(F.regexp_extract("col", r"(?is)^<a\s[^>]*>(.*)</a>$", 1), r"<[^>]*>", ""))
    target = F.coalesce(*(F.nullif(F.regexp_extract("col", p, 1), F.lit("")) for p in (r"(?i)href\s*=\s*\"([^\"]*)\"", r"(?i)href\s*=\s*'([^']*)'", r"(?i)href\s*=\s*([^\s>\"']+)")), F.lit(""))
    return rows.select(key, (F.col("pos") + 1).cast("long").alias("position"), target.alias("target"), label.alias("label"))


def absolute(base: Column, target: Column) -> Column:
    """A link's target as a whole URL, from the URL of its page; targets with a scheme stay."""
    scheme, origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.regexp_extract(page, r"://[^/]*(/)", 1) == "", F.concat(page, F.lit("/"))).otherwise(F.regexp_extract(page, r"^(.*/)", 1))
    return (
        F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), target))
        .when(target.startswith("?"), F.concat(page, target))
        .when(target == "", F.regexp_extract(base, r"^([^#]*)", 1))
        .otherwise(F.concat(folder, target))
    )


def table_rows(df: DataFrame, key: str, html: str = "html", least: int = 1) -> DataFrame:
    """Rows of tables with least cells or more: position, cells without markup, and the first link."""
    rows = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))))
    cells = F.transform(F.regexp_extract_all("col", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))
    out = rows.select(key, (F.col("pos") + 1).cast("long").alias("position"), cells.alias("cells"), F.regexp_extract("col", r"(?i)href=\"([^\"]*)\"", 1).alias("target"))
    return out.where(F.size("cells") >= least)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder tree as documents: a file in the top folder is one page, a folder's files are its pages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    relative = F.expr(f"substring(path, instr(path, '{path.rstrip('/')}') + {len(path.rstrip('/')) + 1})")
    document = F.when(relative.contains("/"), F.substring_index(relative, "/", 1)).otherwise(F.regexp_replace(relative, r"\.[^.]*$", ""))
    return files.groupBy(document.alias("document")).agg(F.array_sort(F.collect_list("path")).alias("pages"))


def handoff(rows: DataFrame, manifest: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    """Rows in some statuses with their manifest entries."""
    return rows.where(F.col("status").isin(statuses)).join(manifest, key, "left")


def request_key(endpoint: Column, parameters: Column) -> Column:
    """The key of a cached answer: endpoint and parameters (a map) in the order of their names."""
    pairs = F.array_sort(F.transform(F.map_entries(parameters), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.sha2(F.concat_ws("?", endpoint, F.array_join(pairs, "&")), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (endpoint, parameters) with the cache's answers (key, answer); nothing is fetched."""
    return requests.withColumn("key", request_key(F.col("endpoint"), F.col("parameters"))).join(cache, "key", "left")


def medications(df: DataFrame, key: str, json: str) -> DataFrame:
    """Medication objects of a JSON document at its five known places, in order; the primary ones first."""
    places = ["$.raw_entities.medications", "$.raw_entities.clinical_notes.medications", "$.raw_entities.prescription", "$.raw_entities.plan_of_care.medications"]
    found = [F.coalesce(F.from_json(F.get_json_object(json, p), "array<string>"), F.array().cast("array<string>")) for p in places]
    arrays = F.array(*(F.struct(F.lit(p).alias("place"), a.alias("items")) for p, a in zip(places, found, strict=True)))
    references = F.from_json(F.get_json_object(json, "$.reference_annotations"), "array<string>")
    extra = F.transform(F.coalesce(references, F.array().cast("array<string>")), lambda r: F.struct(F.lit("$.reference_annotations").alias("place"), F.coalesce(F.from_json(F.get_json_object(r, "$.raw_entities.medications"), "array<string>"), F.array().cast("array<string>")).alias("items")))
    rows = df.select(key, F.posexplode(F.concat(arrays, extra)).alias("part", "group")).select(key, "part", "group.place", F.posexplode("group.items").alias("position", "item"))
    name = F.coalesce(*(F.get_json_object("item", f"$.{f}") for f in ("raw_medication_text", "name", "medicine", "medicine_name")))
    return rows.select(key, "place", "part", "position", name.alias("name"), (F.col("place") == "$.reference_annotations").alias("is_reference"))


def saved(spark: SparkSession, name: str, columns: list[str], condition: str | None = None) -> DataFrame:
    """Columns of a table of the session's catalog; the condition goes to the scan."""
    df = spark.table(name)
    return (df.where(condition) if condition else df).select(*columns)
