"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, split_join, stash

#: Kind, pattern, group that holds the value, and characters that the value needs at least. Fixed values.
KINDS = [
    ("assign", r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]+)", 1, 32),
]
#: What makes a document worth the search for positions; every match of the kind that counts contains one of these.
_HINTS = {"assign": KINDS[0][1], "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
#: The method's own kind: long tokens of mixed characters. They are secrets only if ownership says so.
GENERIC = r"([A-Za-z0-9+/_=-]{20,})"
#: A value that more owners, or more repositories, than this have is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 3
#: Values that contain one of these words, or have fewer different characters, don't look live.
_PLACEHOLDER, DISTINCT = r"(?i)example|changeme|placeholder|your_|dummy|sample|xxxx", 8

_CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(steps: Column) -> Column:
    """Inclusive running totals of an array of ints; blocks keep the copying far below the square of its length."""
    block = lambda b: F.slice(steps, b * _CHUNK + 1, F.lit(_CHUNK))
    append = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda s, x: s + x))
    begins = F.aggregate(sums, F.array(F.lit(0)), append)
    inside = lambda at: lambda b: F.slice(F.aggregate(block(b), F.array(F.element_at(at, b + 1)), append), F.lit(2), F.lit(_CHUNK))
    return _let(begins, lambda at: F.flatten(F.transform(blocks, inside(at))))


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern as array<struct<start, end, kind, value>>: what lies between matches gives positions."""
    lengths = lambda parts: F.transform(parts, F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    value = whole if group == 1 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def place(found: Column) -> Column:
        size = found["size"]
        steps = F.zip_with(F.slice(found["gaps"], F.lit(1), F.size(size)), F.concat(F.array(F.lit(0)), F.slice(size, F.lit(1), F.size(size) - 1)), lambda g, m: g + m)
        rows = F.arrays_zip(_let(steps, _running).alias("start"), size.alias("size"), found["value"].alias("value"))
        kept = F.filter(rows, lambda r: F.length(r["value"]) >= least)
        return F.transform(kept, lambda r: F.struct(r["start"].cast("long").alias("start"), (r["start"] + r["size"]).cast("long").alias("end"), F.lit(kind).alias("kind"), r["value"].alias("value")))

    return _let(F.struct(lengths(F.split(text, pattern, -1)).alias("gaps"), lengths(whole).alias("size"), value.alias("value")), place)


_SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, hint: str) -> Column:
    seen = text.contains("AKIA") & text.rlike(hint) if kind == "access" else text.rlike(hint)
    return F.when(seen, _found(text, kind, pattern, group, least)).otherwise(F.array().cast(_SPAN))


def _live_looking(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & ~value.rlike(_PLACEHOLDER)


def _candidate(s: Column, own: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash"), _live_looking(s["value"]).alias("live_looking"), own.alias("base"))


def secret_spans(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Each document's secrets and what the corpus says about them.

    docs: doc_id long, text string, and what repository and owner read (by default source/lang and source); other
    columns are ignored. Returns one row for each input row: doc_id, text_key (xxhash64 of the text), and spans, an
    array of struct<start, end, kind, base, verdict, n_owners, n_repositories> in order of start and kind.

    Candidates are the base kinds' values and long tokens of mixed characters. Only their hashes leave the scan: they
    are aggregated by repository and owner (distinct triples first, so that a value in a third of all rows is a few
    rows after the map side), and a value that more than max_owners owners or more than max_repositories repositories
    have is "copied". One that is specific to few is "live" if it looks it, else "unlikely". A value in very many rows is
    joined with its counts in parts. Base spans are always returned; long tokens only when they are live and
    outside of base spans. Documents without candidates take no part in any shuffle but the last join.

    Null texts count as empty. Null repositories and owners count as one of their own. Null doc_ids and repeated rows
    are returned as they are.
    """
    repository = repository if repository is not None else F.concat_ws("/", "source", "lang")
    owner = owner if owner is not None else F.col("source")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    text = F.col("text")
    rows = rows.select("doc_id", "repository", "owner", F.xxhash64("text").alias("text_key"), *(_spans(text, *k, _HINTS[k[0]]).alias(k[0]) for k in KINDS), _spans(text, "generic", GENERIC, 1, 20, GENERIC).alias("generic"))
    rows = rows.withColumn("found", F.concat(*(k[0] for k in KINDS)))
    alone = F.filter("generic", lambda g: g["value"].rlike("[0-9]") & g["value"].rlike("[A-Za-z]") & ~F.exists("found", lambda s: (s["start"] < g["end"]) & (g["start"] < s["end"])))
    base = F.transform("found", lambda s: _candidate(s, F.lit(True)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "repository", "owner", base.alias("base"), F.transform(alone, lambda s: _candidate(s, F.lit(False))).alias("generic"))
    rows = stash(rows, "candidates")  # row is fixed from here on

    candidates = rows.select("row", "repository", "owner", F.explode(F.concat("base", "generic")).alias("c")).select("row", "repository", "owner", "c.*")
    owned = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    owned = owned.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    verdict = F.when((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories), "copied").when(F.col("live_looking"), "live").otherwise("unlikely")
    judged = split_join(candidates, owned, "hash", hot_keys(candidates, "hash")).withColumn("verdict", verdict).where("base or verdict = 'live'")
    place = F.array_position(F.array(*(F.lit(k[0]) for k in KINDS), F.lit("generic")), F.col("kind"))
    judged = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "base", "verdict", "n_owners", "n_repositories"))).alias("spans"))
    spans = F.transform(F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "kind", "base", "verdict", "n_owners", "n_repositories"))))
    return rows.select("row", "doc_id", "text_key").join(judged, "row", "left").select("doc_id", "text_key", spans.alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, all spans, the verdicts' counts, and the most owners
    and repositories that a span's value has (0 without spans)."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: lambda s: s["base"] & (s["kind"] == k)
    of_verdict = lambda v: lambda s: s["verdict"] == v
    kinds = [count(of_kind(k)).alias(f"n_{k}") for k, *_ in KINDS]
    verdicts = [count(of_verdict(v)).alias(f"n_{v}") for v in ("live", "copied")]
    most = [F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).cast("long").alias(f"most_{c[2:]}") for c in ("n_owners", "n_repositories")]  # noqa: B023  used at once
    return found.select("doc_id", *kinds, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *verdicts, *most)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with each found span's text replaced: [SECRET], or [EXAMPLE_SECRET] where it is a copied example.

    Overlapping spans become one replacement. Documents without spans come through unchanged, and so does null text.
    """
    spans = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("span_id"), "text_key", "spans").dropDuplicates(["span_id", "text_key"])

    def merge(done: Column, s: Column) -> Column:
        top = F.try_element_at(done, F.lit(-1))
        apart = F.coalesce(top["end"] <= s["start"], F.lit(True))
        both = F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"), (top["copied"] & s["copied"]).alias("copied"))
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(both)))

    simple = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["verdict"] == "copied").alias("copied")))
    spans = spans.withColumn("spans", F.aggregate(simple, F.array().cast("array<struct<start:bigint,end:bigint,copied:boolean>>"), merge))
    text = F.col("text")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    parts = F.transform(
        F.sequence(F.lit(1), F.size("spans")),
        lambda i: F.concat(
            F.substring(text, (F.element_at(starts, i) + 1).cast("int"), (F.element_at(F.col("spans"), i)["start"] - F.element_at(starts, i)).cast("int")),
            F.when(F.element_at(F.col("spans"), i)["copied"], "[EXAMPLE_SECRET]").otherwise("[SECRET]"),
        ),
    )
    tail = F.substring(text, (F.element_at(F.col("spans"), -1)["end"] + 1).cast("int"), F.length(text))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["span_id"]) & (key == spans["text_key"]), "left")
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))
    return joined.withColumn("text", clean).select(*docs.columns)
