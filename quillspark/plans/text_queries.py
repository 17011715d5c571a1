"""Text normalization and parsing over catalogs, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import ordered
from ..sources import readers
from .registry import query, table

NORM = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), '[^a-z0-9%./+ -]+', '', 'g'), '\s+', ' ', 'g'))"


@query(f"select p_partkey, {NORM.format('p_name')} as norm, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) as surface from part")
def normalize_text(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.normalize_text(F.col("p_name"), True).alias("norm"), text.lexical_surface(F.col("p_name"), True).alias("surface"))


@query(
    """select item_id, coalesce(array_to_string(list_filter(regexp_split_to_array("""
    + NORM.format("regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')")
    + """, '[^a-z0-9]+'), lambda t: length(t) > 1), ' '), '') as tokens from benchmark"""
)
def tokenize(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    return b.select("item_id", F.array_join(text.tokens(F.col("text"), True), " ").alias("tokens"))


@query(
    f"""with b as (select p_partkey, {NORM.format("'tab. ' || p_name || ' ' || p_size || ' mg'")} as n from part),
    c as (select p_partkey, n, trim(regexp_replace(regexp_replace(regexp_replace(n, '\\b(tab|tabs|tablet|cap|caps|capsule|syp|syr|syrup|inj|injection|drop|drops|cream|oint|ointment)\\b\\.?', ' ', 'g'), '\\b\\d+(\\.\\d+)?\\s*(mg|mcg|g|ml|iu|units?|%)\\b', ' ', 'g'), '\\s+', ' ', 'g')) as s from b)
    select p_partkey, case when s <> '' then s else n end as surface from c"""
)
def clean_surface(spark, sf):
    name = F.concat(F.lit("tab. "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg"))
    return table(spark, sf, "part").select("p_partkey", text.query_surface(name, True).alias("surface"))


@query("select p_partkey, 'PART_' || substr(sha256(p_name || '||' || p_brand), 1, 20) as id from part")
def stable_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.stable_id("PART", F.col("p_name"), F.col("p_brand")).alias("id"))


@query(
    """select o_orderkey, lpad(cast(day(o_orderdate) as varchar), 2, '0') || '-' || lpad(cast(month(o_orderdate) as varchar), 2, '0') || '-' || year(o_orderdate) as d from orders"""
)
def normalize_dates(spark, sf):
    d = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit("/"), F.month("o_orderdate").cast("string"), F.lit("."), F.year("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", text.normalize_date(d, True).alias("d"))


@query("select conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as norm from conversations")
def comparison_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alphanumeric(F.col("text")).alias("norm"))


@query(
    """select o_orderkey, case o_orderpriority when '1-URGENT' then 'immediately' when '2-HIGH' then 'twice daily' when '3-MEDIUM' then 'at bedtime' else 'as needed' end || ' tablet oral' as expanded from orders"""
)
def expand_abbreviations(spark, sf):
    short = F.when(F.col("o_orderpriority") == "1-URGENT", "STAT").when(F.col("o_orderpriority") == "2-HIGH", "BD").when(F.col("o_orderpriority") == "3-MEDIUM", "hs").otherwise("sos")
    return table(spark, sf, "orders").select("o_orderkey", text.expand_abbreviations(F.concat(short, F.lit("  Tab PO"))).alias("expanded"))


@query(
    """select p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) as family, p_size || 'mg' as strength, case p_size % 3 when 0 then 'tablet' when 1 then 'syrup' else 'capsule' end as form,
    case p_size % 3 when 0 then 'SR' else '' end as release_modifier from part"""
)
def parse_products(spark, sf):
    form = F.when(F.col("p_size") % 3 == 0, " SR Tab").when(F.col("p_size") % 3 == 1, " Syp").otherwise(" Caps")
    label = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".0 mg"), form)
    p = table(spark, sf, "part").select("p_partkey", label.alias("label"))
    label = F.col("label")
    return p.select("p_partkey", parsing.brand_family(label, True).alias("family"), parsing.strength(label, True).alias("strength"), parsing.dosage_form(label, True).alias("form"), parsing.release_modifier(label, True).alias("release_modifier"))


@query(
    """with c as (select l_orderkey, lower(p_name) as i, cast(l_linenumber as varchar) || '0mg' as s from lineitem join part on l_partkey = p_partkey)
    select l_orderkey, string_agg(i || ':' || s, '|' order by i, s) || '|form:tablet' as signature, count(*) as components from c group by l_orderkey"""
)
def formulation_signatures(spark, sf):
    """Compositions written as text, parsed back, and signed."""
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    piece = F.concat("p_name", F.lit(" ("), F.col("l_linenumber").cast("string"), F.lit("0 mg)"))
    text_ = line.groupBy("l_orderkey").agg(F.array_join(F.collect_list(piece), " + ").alias("composition"))
    c = text_.withColumn("c", parsing.composition(F.col("composition"), True))
    return c.select("l_orderkey", parsing.formulation_signature(F.col("c"), F.lit("tablet")).alias("signature"), F.size("c").cast("long").alias("components"))


@query(
    """with t as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
    p(category, pattern) as (values ('token', '(?i)\\btoken\\s*[:=]'), ('password', '(?i)\\bpassword\\s*[:=]'), ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+'), ('address', '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b'))
    select doc_id, cast(line_no as bigint) as line_no, category from t, p where regexp_matches(line, pattern)"""
)
def line_scan(spark, sf):
    """Lines against a short list of patterns: the list is an array in the plan, so that lines are read once."""
    patterns = {"token": r"(?i)\btoken\s*[:=]", "password": r"(?i)\bpassword\s*[:=]", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"}
    rows = readers.lines(table(spark, sf, "documents"), "doc_id")
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(c)) for c, p in patterns.items())))
    return rows.select("doc_id", "line_no", F.explode(hits).alias("category"))


@query(
    """select page_id, cast(position as bigint) as position, regexp_extract(a, 'href="([^"]*)"', 1) as target, regexp_extract(a, '>([^<]*)</a>', 1) as label
    from (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) as a, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>[^<]*</a>'), 1) as position from pages)"""
)
def page_links(spark, sf):
    return readers.links(table(spark, sf, "pages"), "page_id")


@query(
    """with t as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
    r as (select *, sum(case when regexp_matches(line, '^[A-E]') then 1 else 0 end) over (partition by doc_id order by n) as record from t)
    select doc_id, cast(record as bigint) as record, string_agg(line, ' ' order by n) as text, count(*) as lines from r where record > 0 group by doc_id, record"""
)
def line_segmentation(spark, sf):
    rows = readers.lines(table(spark, sf, "documents"), "doc_id")
    return ordered.segments(rows, "doc_id", "line_no", F.col("line").rlike("^[A-E]"))


@query(
    """with t as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
    h as (select *, case when length(line) < 60 then line end as header from t)
    select doc_id, cast(n as bigint) as line_no, last_value(header ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and current row) as section from h"""
)
def section_forward_fill(spark, sf):
    rows = readers.lines(table(spark, sf, "documents"), "doc_id")
    header = F.when(F.length("line") < 60, F.col("line"))
    return rows.select("doc_id", "line_no", ordered.fill_forward(rows, ["doc_id"], "line_no", header).alias("section"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type from events where json_extract(props, '$.k') is not null")
def json_fields(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").where("k is not null")
