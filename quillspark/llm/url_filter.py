"""URL filters: host rules, and pattern rules indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, small_side, stash

#: Host rules: verdict, and host with path. Fixed values.
HOST_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Pattern rules: verdict and pattern over the lower-cased url. "||" begins a host or a part of it after a dot, "|" begins
#: or ends the url, "^" is a separator or the end, "*" is any text; an allow rule outweighs block rules.
PATTERN_RULES = [
    ("block", "||ads-track."),
    ("block", "||adult-x."),
    ("block", "||casino."),
    ("block", "/login^"),
    ("block", "/cart^"),
    ("block", "/track/*/click^"),
    ("allow", "||adult-education."),
]
#: Rows of a side that may be broadcast.
SMALL_ROWS = 100_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both are empty without "://"."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(u, shape, 1)), F.regexp_extract(u, shape, 2)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1)))


def _expression(pattern: Column) -> Column:
    """The regular expression of a pattern; bars count as anchors at its ends only."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\A\|{1,2}", ""), r"\|\z", "")
    out = F.regexp_replace(body, r"([.+?$(){}\[\]\\|])", r"\\$1")
    out = F.regexp_replace(out, r"\*", ".*")
    out = F.regexp_replace(out, r"\^", "(?:[^a-z0-9_.%-]|\\$)")
    begins = F.when(pattern.startswith("||"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?").when(pattern.startswith("|"), "^").otherwise("")
    return F.concat(begins, out, F.when(pattern.rlike(r"(?s).\|\z") & (F.length(pattern) > 2), "$").otherwise(""))


def _literals(pattern: Column) -> Column:
    """Tokens that every url which matches must hold whole: runs between separators or anchors, not beside wildcards."""
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1)))


def _host_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct url that some host rule fits: the longest such rule (ties: the longer host)."""
    rule = rules.select(F.col("verdict").alias("rule_verdict"), F.col("rule"), lower_ascii(F.substring_index("rule", "/", 1)).alias("suffix"))
    rule = rule.withColumn("prefix", F.expr("substring(rule, length(suffix) + 1)"))
    # No rule's host has more labels than this: a host's longer suffixes aren't made.
    depth = rule.agg(F.max(F.size(F.split("suffix", r"\.", -1)))).first()[0] or 1
    labels = F.slice(F.split("host", r"\.", -1), F.greatest(F.size(F.split("host", r"\.", -1)) - depth, F.lit(0)) + 1, F.lit(depth))
    suffixes = urls.where("host <> ''").select("url_key", "path", labels.alias("labels"))
    suffixes = suffixes.select("url_key", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("suffix"))
    fits = suffixes.join(small_side(rule, SMALL_ROWS), "suffix").where("startswith(path, prefix)")
    best = F.max(F.struct(F.length("rule").alias("size"), F.length("suffix").alias("host_size"), "rule", "rule_verdict")).alias("best")
    return fits.groupBy("url_key").agg(best).select("url_key", "best.rule", "best.rule_verdict")


def _pattern_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each url that some pattern rule matches: block, or allow if an allow rule matches too.

    Every rule is posted under the one of its literal tokens that the fewest urls hold. A url's tokens fetch its
    candidates; regular expressions run on those alone. A rule without a literal token is a candidate for every url:
    such rules meet the urls in parts, dealt by a hash, so that no token's urls meet in one task.
    """
    tokens = urls.select("url_key", F.explode(_tokens(F.col("lowered"))).alias("token"), "lowered")
    rules = rules.select(F.col("verdict").alias("rule_verdict"), lower_ascii(F.col("pattern")).alias("pattern")).distinct()
    literal = _literals(F.col("pattern"))
    wanted = rules.select("pattern", F.explode(literal).alias("token"))
    held = stash(wanted.select("token").distinct(), "rule-tokens")
    seen = tokens.join(small_side(held, SMALL_ROWS), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(seen, "token", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).select("pattern", F.col("r.token").alias("token"))
    posted = stash(rules.join(rarest, "pattern").select("token", "rule_verdict", _expression(F.col("pattern")).alias("expression")), "posted-rules")
    hits = tokens.join(small_side(posted, SMALL_ROWS), "token").where(F.regexp("lowered", F.col("expression")))
    bare = stash(rules.where(F.size(literal) == 0).select("rule_verdict", _expression(F.col("pattern")).alias("expression")), "bare-rules")
    if bare.limit(1).count():
        parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = bare.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        of = urls.select("url_key", "lowered", F.pmod(F.xxhash64("url_key"), F.lit(parts)).cast("int").alias("part"))
        hits = hits.select("url_key", "rule_verdict").union(of.join(each, "part").where(F.regexp("lowered", F.col("expression"))).select("url_key", "rule_verdict"))
    return hits.groupBy("url_key").agg(F.min("rule_verdict").alias("pattern_verdict"))  # allow < block


def url_verdicts(pages: DataFrame, host_rules: DataFrame, pattern_rules: DataFrame) -> DataFrame:
    """Host, path, fitting host rule and verdict of every page's url.

    pages: page_id long, url string; host_rules: verdict, rule (host and path); pattern_rules: verdict, pattern (as
    PATTERN_RULES). Other columns are ignored. Returns page_id, host, path, rule, verdict:
    that of the longest host rule which fits, else that of the pattern rules, else allow.

    The work is done once for each distinct url, so that a url in a third of all rows costs no more than another; the
    rules' sides are broadcast only if a count shows them to be small. Null urls have an empty host and path, fit no
    rule and are allowed. Null page_ids and repeated rows are returned as they are.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url_key"))
    host, path = parts(F.col("url_key"))
    urls = stash(rows.select("url_key").distinct().select("url_key", host.alias("host"), path.alias("path"), lower_ascii(F.col("url_key")).alias("lowered")), "urls")
    judged = urls.join(_host_verdicts(urls, host_rules), "url_key", "left").join(_pattern_verdicts(urls, pattern_rules), "url_key", "left")
    judged = judged.select("url_key", "host", "path", "rule", F.coalesce("rule_verdict", "pattern_verdict", F.lit("allow")).alias("verdict"))
    return rows.join(judged, "url_key").select("page_id", "host", "path", "rule", "verdict")
