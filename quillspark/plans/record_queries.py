"""Records from JSON, semantic and online decisions, rates, roles, summaries, dictionaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assembly, decision, evaluation, records, retrieval
from .assembly_queries import _wide
from .decision_queries import _ROWS, _evidence
from .registry import query, table

_LINES = "l as (select l_orderkey, p_name, p_type, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, p_name) - 1 as position from lineitem join part on l_partkey = p_partkey)"


def _order_documents(spark, sf):
    """A JSON document for each order: every third one a list, every third with mentions, every third with entities."""
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct("l_linenumber", F.struct(F.col("p_name").alias("raw_medication_text"), F.col("l_quantity").cast("string").alias("raw_strength_text")).alias("x"))
    rows = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias("items"))
    uid, kind = F.concat(F.lit("O"), "l_orderkey"), F.col("l_orderkey") % 3
    as_mentions = F.to_json(F.struct(uid.alias("document_uid"), F.col("items").alias("mentions")))
    as_entities = F.to_json(F.struct(uid.alias("document_uid"), F.struct(F.col("items").alias("medications")).alias("raw_entities")))
    return rows.select("l_orderkey", F.when(kind == 0, F.to_json("items")).when(kind == 1, as_mentions).otherwise(as_entities).alias("body"))


_UID = "case when l_orderkey % 3 = 0 then 'DOC_' || substr(sha256('' || l_orderkey), 1, 20) else 'O' || l_orderkey end"


@query(f"with {_LINES}, u as (select *, {_UID} as uid from l) select l_orderkey, position, 'MENTION_' || substr(sha256(uid || '||' || p_name || '||' || position), 1, 20) as mention_id, uid as document_uid, p_name as text from u")
def json_mentions(spark, sf):
    return records.mentions(_order_documents(spark, sf), "l_orderkey", "body").select("l_orderkey", "position", "mention_id", "document_uid", "text")


@query(
    """with r as (select l_orderkey as mention_id, l_suppkey as candidate_id, l_returnflag as branch, l_linenumber as rank, l_quantity as score, l_linestatus as alias from lineitem),
    b as (select *, row_number() over (partition by mention_id, candidate_id order by rank, score desc, alias) as n from r where branch = 'R'), c as (select distinct mention_id, candidate_id from r)
    select c.mention_id, c.candidate_id, case when b.rank is null then 'NOT_COMPARABLE' else 'MATCH' end as semantic_status, b.rank as semantic_rank, b.score as semantic_score, b.alias as semantic_alias from c left join b on b.mention_id = c.mention_id and b.candidate_id = c.candidate_id and n = 1"""
)
def semantic_evidence(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mention_id"), F.col("l_suppkey").alias("candidate_id"), F.col("l_returnflag").alias("branch"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").alias("score"), F.col("l_linestatus").alias("alias"))
    return decision.semantic_evidence(r.select("mention_id", "candidate_id").distinct(), r, "R")


@query(
    f"""with {_ROWS}, m as (select p_partkey % 50 as mention_id, p_partkey, p_brand, verdict = 'SUPPORTED' as acc, lex = 'MATCH' and not hard and p_brand in (select p_brand from part where p_size > 48) as fam, kind = 'OFFICIAL_SOURCE_RECORD' as off, row_number() over (partition by p_partkey % 50 order by p_size desc, p_partkey) as rank from g),
    f as (select mention_id, min(case when acc or fam then rank end) as a, min(case when not off and not acc and not fam then rank end) as r from m group by 1)
    select f.mention_id, case when a is not null then 'ACCEPT' when r is not null then 'HUMAN_REVIEW' else 'NIL' end as decision, case when a is not null and not acc then 'FAMILY:' || p_brand else cast(p_partkey as varchar) end as candidate_id,
    (a is null and r is null) or (r is not null and (a is null or (r < a and acc))) as has_reasons from f left join m on m.mention_id = f.mention_id and m.rank = coalesce(a, r)"""
)
def online_decision(spark, sf):
    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("p_size"), "p_partkey"))
    rows = _evidence(spark, sf).withColumn("mention_id", F.col("p_partkey") % 50).withColumn("candidate_id", F.col("p_partkey")).withColumn("family", F.col("p_brand"))
    rows = rows.withColumn("final_rank", rank).withColumn("acceptable", decision.acceptance() == "SUPPORTED").withColumn("official", F.col("entity_type") == "OFFICIAL_SOURCE_RECORD").withColumn("reasons", decision.review_reasons())
    out = decision.decide_online(rows, table(spark, sf, "part").where("p_size > 48").select(F.col("p_brand").alias("family")))
    return out.select("mention_id", "decision", "candidate_id", (F.size("reasons") > 0).alias("has_reasons"))


@query(
    f"""with {_ROWS}, s as (select g.*, p_name, case when verdict = 'SUPPORTED' then 'ACCEPT' when p_partkey % 2 = 0 then 'HUMAN_REVIEW' else 'NIL' end as decision from g join part using (p_partkey)),
    v as (select *, case when decision = 'NIL' or kind = 'OFFICIAL_SOURCE_RECORD' then 'NO_SUPPORTED_RESOLUTION' when kind = 'BRAND_PRODUCT' then 'EXACT_LOCAL_PRODUCT' when kind = 'BRAND_FAMILY' then 'LOCAL_BRAND_FAMILY' when kind = 'INGREDIENT' then 'INGREDIENT_ONLY' else 'TERMINOLOGY_ONLY' end as level from s)
    select p_partkey as mention_id, decision, level as resolution_level, case when kind = 'OFFICIAL_SOURCE_RECORD' then '' else cast(p_partkey as varchar) end as primary_candidate_id, case when kind = 'OFFICIAL_SOURCE_RECORD' then '' else p_brand end as family_id,
    case when decision = 'ACCEPT' and level = 'EXACT_LOCAL_PRODUCT' then p_name else '' end as product_name from v"""
)
def layer_b(spark, sf):
    text = lambda c: F.col(c).cast("string")
    facts = F.struct(F.col("p_brand").alias("family_id"), F.col("p_brand").alias("family_name"), text("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.array("p_name").alias("components"), F.lit("").alias("form"), F.lit("").alias("release_modifier"), F.array().cast("array<string>").alias("rxnorm"), F.array("p_brand").alias("atc"))
    rows = _evidence(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    verdict = F.when(decision.acceptance() == "SUPPORTED", "ACCEPT").when(F.col("p_partkey") % 2 == 0, "HUMAN_REVIEW").otherwise("NIL")
    out = decision.layer_b(rows.select(F.col("p_partkey").alias("mention_id"), verdict.alias("decision"), text("p_partkey").alias("candidate_id"), "entity_type", facts.alias("facts")))
    return out.select("mention_id", "decision", "resolution_level", "primary_candidate_id", "family_id", "product_name")


@query(
    """with o as (select l_orderkey as document, count(*) as p, count(*) filter (l_returnflag = 'R') as h, count(*) filter (l_returnflag = 'A') as g, count(*) filter (l_linestatus = 'F') as t, count(*) filter (l_linestatus = 'F' and l_quantity > 25) as m, max(case when l_returnflag = 'R' and l_linenumber = 1 then 1 else 0 end) as x from lineitem group by 1)
    select document, round(case when p + x > 0 then h / (p + x)::double else 0 end, 9) as hallucination_rate, round(case when p + x > 0 then g / (p + x)::double else 0 end, 9) as gap_rate, round(case when t > 0 then m / t::double else 0 end, 9) as missing_rate from o"""
)
def document_rates(spark, sf):
    count = lambda c: F.count_if(F.expr(c))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document")).agg(F.count(F.lit(1)).alias("predictions"), count("l_returnflag = 'R'").alias("hallucinations"), count("l_returnflag = 'A'").alias("gaps"), count("l_linestatus = 'F'").alias("truths"), count("l_linestatus = 'F' and l_quantity > 25").alias("missed"), F.bool_or(F.expr("l_returnflag = 'R' and l_linenumber = 1")).alias("name_hallucinated"))
    return evaluation.document_rates(rows).select("document", *(F.round(c, 9).alias(c) for c in ("hallucination_rate", "gap_rate", "missing_rate")))


@query(
    """with r as (select 'rich' as role, * from customer where c_acctbal > 0 union all select 'near', * from customer where c_nationkey < 5 union all select 'building', * from customer where c_mktsegment = 'BUILDING')
    select role, c_custkey, c_acctbal from (select *, row_number() over (partition by role order by c_acctbal desc, c_custkey) as n from r) where n = 1"""
)
def best_of_roles(spark, sf):
    roles = {"rich": F.col("c_acctbal") > 0, "near": F.col("c_nationkey") < 5, "building": F.col("c_mktsegment") == "BUILDING"}
    return evaluation.best_of_roles(table(spark, sf, "customer"), roles, "c_acctbal", "c_custkey").select("role", "c_custkey", "c_acctbal")


@query("select l_orderkey as mention_id, l_returnflag as branch, l_linenumber as rank, l_suppkey as candidate_id, row_number() over (partition by l_orderkey order by case l_returnflag when 'R' then 1 when 'N' then 2 when 'A' then 3 end, l_linenumber, l_suppkey) as place from lineitem")
def branch_order(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mention_id"), F.col("l_returnflag").alias("branch"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("candidate_id"))
    place = F.row_number().over(Window.partitionBy("mention_id").orderBy("branch_order", "rank", "candidate_id"))
    return evaluation.in_branch_order(t, ["R", "N", "A"]).withColumn("place", place).drop("branch_order")


@query(
    """with s as (select count(*) as masks, count(distinct event_type) as layouts from events), c as (select max(n) as n from (select count(*) as n from events group by event_type))
    select masks, layouts, c.n / masks::double as common_share, (select median(value) from events where user_id % 3 > 0) as median_area, (select count(*) from events where user_id % 3 = 0) as uncertain, (select median(l_discount) from lineitem) as median_l_discount, (select median(l_tax) from lineitem) as median_l_tax from s, c"""
)
def study_summary(spark, sf):
    masks = table(spark, sf, "events").select(F.col("event_type").alias("layout"), F.col("value").alias("area"), (F.col("user_id") % 3 > 0).alias("attributable"))
    return evaluation.study_summary(masks, table(spark, sf, "lineitem").select("l_discount", "l_tax"))


@query(
    """with s as (select p_partkey, lower(case p_size % 4 when 0 then p_name || ' 5 mg' when 1 then p_name || ' + x' when 2 then 'tab ' || p_name else p_name end) as t, p_size % 9 as hits, case when p_size % 3 > 0 then (p_size % 3) / 2.0 end as e, p_partkey % 2 = 0 as ing from part)
    select p_partkey, case when hits = 0 then 'low_resource_unresolved' when regexp_matches(t, '[0-9]+(\\.[0-9]+)?\\s*(mg|mcg|g|ml|iu|%)') then 'strength_bearing' when (contains(t, '+') or contains(t, '/') or contains(t, 'with')) and contains(t, ' ') then 'fdc_looking' when length(t) <= 5 or starts_with(t, 'tab ') then 'abbreviation'
    when e >= 0.999 then (case when ing then 'generic_name' else 'exact_looking_brand' end) when e is not null then 'misspelling_or_variant' else 'generic_name' end as category from s"""
)
def surface_category(spark, sf):
    size, name = F.col("p_size"), F.col("p_name")
    t = F.lower(F.when(size % 4 == 0, F.concat(name, F.lit(" 5 mg"))).when(size % 4 == 1, F.concat(name, F.lit(" + x"))).when(size % 4 == 2, F.concat(F.lit("tab "), name)).otherwise(name))
    return table(spark, sf, "part").select("p_partkey", evaluation.surface_category(t, size % 9, F.when(size % 3 > 0, (size % 3) / 2.0), F.col("p_partkey") % 2 == 0).alias("category"))


@query(
    """with w as (select p_partkey, unnest(list_transform(range(1, 1 + len(regexp_extract_all(lower(p_name), '[a-z0-9]+'))), lambda i: {'position': i, 'term': regexp_extract_all(lower(p_name), '[a-z0-9]+')[i]})) as r from part),
    d as (select distinct lower(split_part(p_name, ' ', 1)) as term from part)
    select p_partkey, r.position as position, r.term as term, 'first' as kind from w join d on d.term = r.term"""
)
def dictionary_entities(spark, sf):
    p = table(spark, sf, "part")
    words = p.select(F.substring_index("p_name", " ", 1).alias("term"), F.lit("first").alias("kind")).distinct()
    return assembly.dictionary_entities(p, "p_partkey", "p_name", words)


@query(
    """with n as (select min(p_partkey) as id, lower(p_name) as t from part group by p_name), p as (select a.id as mention_id, b.id as candidate_id, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))::double, 9) as score from n a, n b),
    r as (select *, row_number() over (partition by mention_id order by score desc, candidate_id) as rank from p where score >= 0.3)
    select mention_id, candidate_id, round(score, 6) as score, rank from r where rank <= 75"""
)
def fuzzy_scan(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    score = F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")), 9)
    out = retrieval.fuzzy_scan(names.select(F.col("id").alias("mention_id"), F.col("p_name").alias("text")), names.select(F.col("id").alias("candidate_id"), F.col("p_name").alias("name")), score, 0.3, ascii_only=True)
    return out.select("mention_id", "candidate_id", F.round("score", 6).alias("score"), "rank")


@query(
    """select 'brand' as dimension, cast(p_brand as varchar) as id, cast(arg_min(p_name, k) as varchar) as value from w group by 2 union all select 'type', p_type, cast(arg_min(p_brand, k) as varchar) from w group by 2 union all
    select 'size', cast(p_size as varchar), cast(arg_min(p_type, k) as varchar) from w group by 2 union all select 'supplier', cast(l_suppkey as varchar), cast(arg_min(s_name, k) as varchar) from w group by 2 union all
    select 'nation', cast(s_nationkey as varchar), cast(arg_min(s_name, k) as varchar) from w group by 2 union all select 'product', cast(l_partkey as varchar), cast(arg_min(p_name, k) as varchar) from w group by 2 union all select 'fact', 'rows', cast(count(*) as varchar) from w""".replace("from w", "from (select *, l_orderkey * 10 + l_linenumber as k from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey) w")
)
def star_tables(spark, sf):
    dims = {"brand": ("p_brand", "p_name"), "type": ("p_type", "p_brand"), "size": ("p_size", "p_type"), "supplier": ("l_suppkey", "s_name"), "nation": ("s_nationkey", "s_name"), "product": ("l_partkey", "p_name")}
    made = assembly.star(_wide(spark, sf), ["seq", "row"], {n: (F.col(k), [v]) for n, (k, v) in dims.items()}, each=True)
    out = made["fact"].agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("fact").alias("dimension"), F.lit("rows").alias("id"), "value")
    for n, (_, v) in dims.items():
        out = out.union(made[n].select(F.lit(n), F.col("id").cast("string"), F.col(v).cast("string")))
    return out


@query("select item_id, trim(regexp_replace(lower(chr(8195) || text || chr(160) || 'END' || chr(28)), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g')) as surface from benchmark")
def unicode_surface(spark, sf):
    """White space beyond ASCII, on the path through compatibility normal forms."""
    from ..functions.text import lexical_surface

    return table(spark, sf, "benchmark").select("item_id", lexical_surface(F.concat(F.lit(" "), "text", F.lit("\xa0END\x1c"))).alias("surface"))


_ALIGNED = "a as (select l_orderkey % 500 as document, l_returnflag as category, case when l_quantity < 30 then 'TP' when l_linestatus = 'F' then 'FP' else 'FN' end as status, l_discount as similarity, case when l_tax > 0.06 then 'gap' when l_tax > 0.03 then 'review' else 'hallucination' end as kind from lineitem)"


def _scored(spark, sf):
    status = F.when(F.col("l_quantity") < 30, "TP").when(F.col("l_linestatus") == "F", "FP").otherwise("FN")
    kind = F.when(F.col("l_tax") > 0.06, "gap").when(F.col("l_tax") > 0.03, "review").otherwise("hallucination")
    return evaluation.scored(table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("document"), F.col("l_returnflag").alias("category"), status.alias("status"), F.col("l_discount").alias("similarity"), kind.alias("kind")))


@query(f"with {_ALIGNED}, c as (select category, count(*) filter (status = 'TP') as tp, count(*) filter (status = 'FP') as fp, count(*) filter (status = 'FN') as fn from a group by 1) select category, tp, fp, fn, round(tp / (tp + fp)::double, 9) as precision, round(tp / (tp + fn)::double, 9) as recall, round(2 * tp / (2 * tp + fp + fn)::double, 9) as f1 from c")
def report_fields(spark, sf):
    return _scored(spark, sf)["fields"].select("category", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"with {_ALIGNED}, c as (select document, count(*) filter (status = 'TP')::double as tp, count(*) filter (status = 'FP') as fp, count(*) filter (status = 'FN') as fn, avg(similarity) as s from a group by 1) select count(*) as documents, round(avg(case when tp + fp > 0 then tp / (tp + fp) else 0 end), 9) as precision, round(avg(case when tp + fn > 0 then tp / (tp + fn) else 0 end), 9) as recall, round(avg(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 9) as f1, round(avg(s), 9) as similarity from c")
def report_summary(spark, sf):
    return _scored(spark, sf)["summary"].select("documents", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "similarity")))


@query(f"with {_ALIGNED} select document, category, kind, count(*) as n from a where kind in ('gap', 'review') group by 1, 2, 3")
def report_review(spark, sf):
    return _scored(spark, sf)["review"].groupBy("document", "category", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select distinct family from (select p_brand as family from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49) union all select p_type from part where p_name in (select p_name from part where p_size = 50))"""
)
def supported_families(spark, sf):
    p = table(spark, sf, "part")
    validated = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("source_id"))
    return decision.supported_families(p.select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("family")), validated, p.select(F.col("p_type").alias("family"), F.col("p_name").alias("name")), p.where("p_size = 50").select(F.col("p_name").alias("name")))


@query("select median(n) as median_candidates from (select l_orderkey, count(distinct l_suppkey) as n from lineitem group by 1)")
def union_size(spark, sf):
    from ..operators import fusion

    return fusion.union_size(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mention_id"), F.col("l_suppkey").alias("candidate_id")))


_PATTERNS = [("assignment", r"(?i)(token|password|secret)\s*[:=]"), ("address", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("mail", r"[a-z0-9]@[a-z0-9]"), ("license", r"(?i)licen[cs]e"), ("address", r"^\+[0-9]")]


@query(
    "with l as (select doc_id, unnest(list_transform(range(1, 1 + len(string_split(text, chr(10)))), lambda i: {'n': i, 't': string_split(text, chr(10))[i]})) as r from documents), p(category, pattern) as (values "
    + ", ".join(f"('{c}', '{p}')" for c, p in _PATTERNS)
    + ") select distinct doc_id, r.n as line_no, category from l join p on regexp_matches(r.t, pattern)"
)
def pattern_scan(spark, sf):
    from ..sources import readers

    lines = readers.lines(table(spark, sf, "documents"), "doc_id")
    return assembly.pattern_scan(lines, spark.createDataFrame(_PATTERNS, "category string, pattern string")).select("doc_id", "line_no", "category")


_TRACE = "t as (select l_orderkey as mention_id, l_returnflag as branch, l_suppkey as candidate_id, l_linenumber as rank, l_linestatus as state, s_name as name, cast(s_nationkey as varchar) as kind from lineitem join supplier on l_suppkey = s_suppkey)"


def _supplier_trace(spark, sf):
    t = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return t.select(F.col("l_orderkey").alias("mention_id"), F.col("l_returnflag").alias("branch"), F.col("l_suppkey").alias("candidate_id"), F.col("l_linenumber").alias("rank"), F.col("l_linestatus").alias("state"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("kind"))


@query(f"with {_TRACE} select mention_id, candidate_id, arg_min(name, rank) as name, arg_min(kind, rank) as kind, string_agg(distinct branch, '|' order by branch) as branches, count(distinct branch) as branch_count, string_agg(distinct state, '|' order by state) as states from t group by 1, 2")
def described_union(spark, sf):
    from ..operators import fusion

    return fusion.described_union(_supplier_trace(spark, sf))


@query(
    f"""with {_TRACE}, u as (select distinct mention_id, candidate_id, branch from t), b as (select distinct branch from t), m as (select distinct mention_id from t),
    c as (select x.mention_id, x.branch as a, y.branch as b, count(*) as n from u x join u y on x.mention_id = y.mention_id and x.candidate_id = y.candidate_id and x.branch < y.branch group by 1, 2, 3)
    select x.branch as a, y.branch as b, median(coalesce(n, 0)) as median_common from m, b x join b y on x.branch < y.branch left join c on c.mention_id = m.mention_id and c.a = x.branch and c.b = y.branch group by 1, 2"""
)
def median_overlap(spark, sf):
    from ..operators import fusion

    return fusion.median_overlap(_supplier_trace(spark, sf))


@query("select page_id, position, case when regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then target else regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || target end as target from (select page_id, url, cast(position as bigint) as position, regexp_extract(a, 'href=\"([^\"]*)\"', 1) as target from (select page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"[^\"]*\"[^>]*>[^<]*</a>')) as a, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href=\"[^\"]*\"[^>]*>[^<]*</a>'), 1) as position from pages))")
def absolute_links(spark, sf):
    from ..sources import readers

    pages = table(spark, sf, "pages")
    return readers.links(pages, "page_id").join(pages.select("page_id", "url"), "page_id").select("page_id", "position", readers.absolute(F.col("url"), F.col("target")).alias("target"))


@query(
    """with n as (select min(p_partkey) as id, lower(p_name) as t from part group by p_name), p as (select a.id as mention_id, b.id as candidate_id, a.t = b.t as same, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))::double, 9) as score from n a, n b where list_has_any(string_split(a.t, ' '), string_split(b.t, ' '))),
    r as (select *, row_number() over (partition by mention_id order by score desc, candidate_id) as rank from p where score >= 0.4)
    select mention_id, candidate_id, case when same or score >= 0.9 or rank <= 3 then 'MATCH' else 'NOT_COMPARABLE' end as lexical_status from r where rank <= 75"""
)
def lexical_evidence(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    m, c = names.select(F.col("id").alias("mention_id"), F.col("p_name").alias("text")), names.select(F.col("id").alias("candidate_id"), F.col("p_name").alias("name"))
    score = F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")), 9)
    rows = retrieval.blocked_fuzzy(m, c, score, 0.4, ascii_only=True).join(m, "mention_id").join(c, "candidate_id")
    return rows.select("mention_id", "candidate_id", decision.lexical_status(F.col("text"), F.col("name"), F.col("score"), F.col("rank")).alias("lexical_status"))


@query(
    """with c as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 'PRODUCT' when 1 then 'SUPPLIER' when 2 then 'ORDER' else 'OTHER' end as entity_type, cast(case l_linenumber % 4 when 0 then l_partkey when 1 then l_suppkey else l_orderkey end as varchar) as entity_id from lineitem)
    select l_orderkey, l_linenumber, entity_type, entity_id, case entity_type when 'PRODUCT' then p_name when 'SUPPLIER' then s_name end as name, case entity_type when 'PRODUCT' then p_brand when 'SUPPLIER' then cast(s_nationkey as varchar) when 'ORDER' then o_orderpriority end as family
    from c left join part on entity_type = 'PRODUCT' and entity_id = cast(p_partkey as varchar) left join supplier on entity_type = 'SUPPLIER' and entity_id = cast(s_suppkey as varchar) left join orders on entity_type = 'ORDER' and entity_id = cast(o_orderkey as varchar)"""
)
def facts_by_type(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["PRODUCT", "SUPPLIER", "ORDER", "OTHER"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    key = F.when(kind == "PRODUCT", F.col("l_partkey")).when(kind == "SUPPLIER", F.col("l_suppkey")).otherwise(F.col("l_orderkey")).cast("string")
    t = lambda n: table(spark, sf, n)
    sources = {"PRODUCT": (t("part"), "p_partkey", {"name": "p_name", "family": "p_brand"}), "SUPPLIER": (t("supplier"), "s_suppkey", {"name": "s_name", "family": "s_nationkey"}), "ORDER": (t("orders"), "o_orderkey", {"family": "o_orderpriority"})}
    return decision.facts_for(t("lineitem").select("l_orderkey", "l_linenumber", kind.alias("entity_type"), key.alias("entity_id")), sources, ["name", "family"])
