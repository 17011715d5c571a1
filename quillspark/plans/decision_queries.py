"""Evidence, decisions, facts and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import decision, fusion
from ..sources import readers, writers
from .registry import query, table


def _products(spark, sf):
    p = table(spark, sf, "part")
    seen = F.struct(
        F.when(F.col("p_size") % 4 > 0, F.concat((F.col("p_size") % 3).cast("string"), F.lit("mg"))).otherwise("").alias("strength"),
        F.when(F.col("p_size") % 5 > 0, F.element_at(F.array(F.lit("tablet"), F.lit("syrup")), (F.col("p_size") % 2 + 1).cast("int"))).otherwise("").alias("form"),
        F.when(F.col("p_size") % 6 > 0, F.col("p_size") % 3).alias("component_count"),
        F.when(F.col("p_size") % 7 > 2, "SR").otherwise("").alias("release_modifier"),
        (F.col("p_size") % 2 == 0).alias("combination"),
    )
    known = F.struct(
        F.array(F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("mg")), F.lit("")).alias("strengths"),
        F.when(F.col("p_partkey") % 5 > 0, "tablet").otherwise("").alias("form"),
        F.when(F.col("p_partkey") % 4 > 0, (F.col("p_partkey") % 3).cast("int")).alias("component_count"),
        F.when(F.col("p_partkey") % 2 > 0, "SR").otherwise("ER").alias("release_modifier"),
    )
    return p.select("p_partkey", seen.alias("seen"), known.alias("known"))


_FORMULATION = """p as (select p_partkey, case when p_size % 4 > 0 then (p_size % 3) || 'mg' else '' end as s, (p_partkey % 3) || 'mg' as ks,
    case when p_size % 5 > 0 then (case when p_size % 2 = 0 then 'tablet' else 'syrup' end) else '' end as f, case when p_partkey % 5 > 0 then 'tablet' else '' end as kf,
    case when p_size % 6 > 0 then p_size % 3 end as c, case when p_partkey % 4 > 0 then p_partkey % 3 end as kc,
    case when p_size % 7 > 2 then 'SR' else '' end as r, case when p_partkey % 2 > 0 then 'SR' else 'ER' end as kr, p_size % 2 = 0 as comb from part),
  e as (select p_partkey, s, case when s = '' then 'NOT_COMPARABLE' when s = ks then 'MATCH' else 'CONFLICT' end as strength_status,
    case when f = '' or kf = '' then 'NOT_COMPARABLE' when f = kf then 'MATCH' else 'CONFLICT' end as form_status,
    case when c is null or kc is null then 'NOT_COMPARABLE' when c = kc then 'MATCH' else 'CONFLICT' end as count_status,
    case when r = '' then 'NOT_COMPARABLE' when r = kr then 'MATCH' else 'CONFLICT' end as release_status,
    case when comb and kc is not null and kc > 0 then (case when kc > 1 then 'MATCH' else 'CONFLICT' end) else 'NOT_COMPARABLE' end as structure_status from p)"""


@query(
    f"""with {_FORMULATION} select p_partkey, strength_status, form_status, count_status, release_status, structure_status,
    array_to_string(list_filter([case when count_status = 'CONFLICT' then 'COMPONENT_COUNT_CONFLICT' end, case when form_status = 'CONFLICT' then 'DOSAGE_FORM_CONFLICT' end, case when structure_status = 'CONFLICT' then 'FDC_STRUCTURE_CONFLICT' end, case when release_status = 'CONFLICT' then 'RELEASE_FORM_CONFLICT' end, case when strength_status = 'CONFLICT' then 'STRENGTH_CONFLICT' end], lambda x: x is not null), '|') as hard,
    array_to_string(list_filter([case when count_status = 'NOT_COMPARABLE' then 'component_count_missing' end, case when form_status = 'NOT_COMPARABLE' then 'dosage_form_missing' end, case when strength_status = 'NOT_COMPARABLE' then 'observed_strength_missing' end, case when release_status = 'NOT_COMPARABLE' then 'release_modifier_missing' end], lambda x: x is not null), '|') as missing from e"""
)
def tristate_evidence(spark, sf):
    found = _products(spark, sf).select("p_partkey", *(c.alias(n) for n, c in decision.formulation("seen", "known").items()))
    return found.withColumn("hard", F.array_join("hard", "|")).withColumn("missing", F.array_join("missing", "|"))


_STATES = "case when x.p_partkey % 4 = 0 then 'CANDIDATE_QUARANTINE' when x.p_partkey % 4 = 1 then 'AUTHORITATIVE_X' end"
_KIND = "case x.p_size % 5 when 0 then 'BRAND_PRODUCT' when 1 then 'BRAND_FAMILY' when 2 then 'INGREDIENT' when 3 then 'RXNORM_CONCEPT' else 'OFFICIAL_SOURCE_RECORD' end"


def _evidence(spark, sf):
    found = _products(spark, sf).select("p_partkey", *(c.alias(n) for n, c in decision.formulation("seen", "known").items()))
    kind = F.element_at(F.array(*map(F.lit, ["BRAND_PRODUCT", "BRAND_FAMILY", "INGREDIENT", "RXNORM_CONCEPT", "OFFICIAL_SOURCE_RECORD"])), (F.col("p_size") % 5 + 1).cast("int"))
    state = F.when(F.col("p_partkey") % 4 == 0, "CANDIDATE_QUARANTINE").when(F.col("p_partkey") % 4 == 1, "AUTHORITATIVE_X")
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", kind.alias("entity_type"), F.array_compact(F.array(state)).alias("states"))
    rows = found.join(p, "p_partkey").withColumn("resolution_level", F.when(F.col("entity_type") == "OFFICIAL_SOURCE_RECORD", "OFFICIAL_EVIDENCE_ONLY").otherwise(decision.resolution(F.col("entity_type"))))
    rows = rows.withColumn("lexical_status", F.when(F.col("p_partkey") % 3 > 0, "MATCH").otherwise("NOT_COMPARABLE")).withColumn("semantic_status", F.when(F.col("p_partkey") % 7 == 0, "MATCH").otherwise("NOT_COMPARABLE"))
    return rows


_ROWS = f"""{_FORMULATION}, k as (select e.*, x.p_size, x.p_brand, {_KIND} as kind, {_STATES} as state, case when x.p_partkey % 3 > 0 then 'MATCH' else 'NOT_COMPARABLE' end as lex, case when x.p_partkey % 7 = 0 then 'MATCH' else 'NOT_COMPARABLE' end as sem,
    'CONFLICT' in (strength_status, form_status, count_status, release_status, structure_status) as hard from e join part x on x.p_partkey = e.p_partkey),
  g as (select *, case when kind = 'OFFICIAL_SOURCE_RECORD' then 'OFFICIAL_SOURCE_RECORD_EVIDENCE_ONLY' when hard then 'HARD_FORMULATION_CONFLICT' when lex <> 'MATCH' and sem <> 'MATCH' then 'WEAK_IDENTITY_EVIDENCE'
    when kind = 'BRAND_PRODUCT' and state = 'CANDIDATE_QUARANTINE' then 'QUARANTINE_ONLY_PRODUCT' when kind = 'BRAND_FAMILY' and state = 'CANDIDATE_QUARANTINE' then 'INSUFFICIENT_SOURCE_SUPPORT' else 'SUPPORTED' end as verdict from k)"""


@query(f"with {_ROWS} select p_partkey, verdict, case when kind = 'RXNORM_CONCEPT' or state = 'AUTHORITATIVE_X' then 'MATCH' when state is not null then 'NOT_COMPARABLE' else 'UNKNOWN' end as provenance from g")
def acceptance_test(spark, sf):
    return _evidence(spark, sf).select("p_partkey", decision.acceptance().alias("verdict"), decision.provenance_status(F.col("states"), F.col("entity_type")).alias("provenance"))


@query(
    f"""with {_ROWS} select p_partkey, coalesce(nullif(array_to_string(list_filter([case when strength_status = 'XX' then '' end, case when form_status = 'CONFLICT' then 'DOSAGE_FORM_CONFLICT' end, case when count_status = 'CONFLICT' or structure_status = 'CONFLICT' then 'FDC_CONFLICT' end,
    case when (kind = 'BRAND_FAMILY' and state = 'CANDIDATE_QUARANTINE') or kind = 'OFFICIAL_SOURCE_RECORD' then 'INSUFFICIENT_SOURCE_SUPPORT' end, case when strength_status = 'NOT_COMPARABLE' then 'MISSING_FORMULATION_EVIDENCE' end, case when kind = 'BRAND_PRODUCT' and state = 'CANDIDATE_QUARANTINE' then 'QUARANTINE_ONLY_PRODUCT' end,
    case when strength_status = 'CONFLICT' then 'STRENGTH_CONFLICT' end, case when kind = 'RXNORM_CONCEPT' then 'TERMINOLOGY_CROSSWALK_UNCERTAIN' end], lambda x: x is not null), '|'), ''), 'MULTIPLE_PLAUSIBLE_CANDIDATES') as reasons from g"""
)
def review_reasons(spark, sf):
    return _evidence(spark, sf).select("p_partkey", F.array_join(decision.review_reasons(), "|").alias("reasons"))


_MENTION = "p_partkey % 50"


@query(
    f"""with {_ROWS}, m as (select {_MENTION} as mention_id, p_partkey as candidate_id, verdict, kind, row_number() over (partition by {_MENTION} order by p_size desc, p_partkey) as final_rank from g),
    f as (select mention_id, min(case when verdict = 'SUPPORTED' then final_rank end) as a, min(case when kind <> 'OFFICIAL_SOURCE_RECORD' then final_rank end) as h from m where final_rank <= 20 group by 1)
    select f.mention_id, case when a is not null then 'ACCEPT' when h is not null then 'HUMAN_REVIEW' else 'NIL' end as decision, m.candidate_id from f left join m on m.mention_id = f.mention_id and m.final_rank = coalesce(a, h)"""
)
def verify_decision(spark, sf):
    from pyspark.sql import Window

    rows = _evidence(spark, sf).withColumn("mention_id", F.col("p_partkey") % 50).withColumn("candidate_id", F.col("p_partkey"))
    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("p_size"), "p_partkey"))
    rows = rows.withColumn("final_rank", rank).where("final_rank <= 20").withColumn("acceptable", decision.acceptance() == "SUPPORTED").withColumn("official", F.col("entity_type") == "OFFICIAL_SOURCE_RECORD")
    return decision.decide(rows)


@query(
    f"""with {_ROWS}, m as (select {_MENTION} as mention_id, p_brand as family, row_number() over (partition by {_MENTION} order by p_size desc, p_partkey) as final_rank, kind, lex, hard from g),
    b as (select mention_id, arg_min(family, final_rank) as fb from m where kind in ('BRAND_PRODUCT', 'BRAND_FAMILY') and lex = 'MATCH' and not hard and family in (select p_brand from part where p_size > 25) group by 1),
    d as (select distinct p_partkey % 60 as mention_id, case when p_partkey % 60 % 3 = 0 then 'ACCEPT' else 'HUMAN_REVIEW' end as decision, case when p_partkey % 60 % 2 = 0 then 'INGREDIENT_ONLY' else 'EXACT_LOCAL_PRODUCT' end as level from part)
    select d.mention_id, case when u then 'ACCEPT' else decision end as decision, case when u then fb else 'none' end as candidate_id, case when u then 'LOCAL_BRAND_FAMILY' else level end as resolution_level, u as fallback_used
    from (select d.*, fb, (decision <> 'ACCEPT' or level = 'INGREDIENT_ONLY') and fb is not null as u from d left join b using (mention_id)) d"""
)
def family_fallback(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("p_size"), "p_partkey"))
    rows = _evidence(spark, sf).withColumn("mention_id", F.col("p_partkey") % 50).withColumn("candidate_id", F.col("p_partkey")).withColumn("family", F.col("p_brand")).withColumn("final_rank", rank)
    d = table(spark, sf, "part").select((F.col("p_partkey") % 60).alias("mention_id")).distinct()
    d = d.select("mention_id", F.when(F.col("mention_id") % 3 == 0, "ACCEPT").otherwise("HUMAN_REVIEW").alias("decision"), F.lit("none").alias("candidate_id"), F.when(F.col("mention_id") % 2 == 0, "INGREDIENT_ONLY").otherwise("EXACT_LOCAL_PRODUCT").alias("resolution_level"))
    return decision.family_fallback(d, rows, table(spark, sf, "part").where("p_size > 25").select(F.col("p_brand").alias("family")))


@query(
    """select l_orderkey, l_linenumber, p_name, s_name, n_name, r_name, c_mktsegment from lineitem join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join customer on o_custkey = c_custkey"""
)
def candidate_facts(spark, sf):
    """The snowflake of lookups around a line: small dimensions broadcast by Catalyst, others joined on their keys."""
    t = lambda n: table(spark, sf, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    rows = rows.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name", "r_name", "c_mktsegment")


@query("select l_orderkey, count(*) as components, string_agg(distinct p_name, ' + ' order by p_name) as names from lineitem join part on l_partkey = p_partkey group by 1 having count(*) > 1")
def combination_view(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("components"), F.array_join(F.array_sort(F.collect_set("p_name")), " + ").alias("names")).where("components > 1")


@query("select distinct node from (select n_name as node from nation union all select r_name from nation join region on n_regionkey = r_regionkey)")
def graph_nodes(spark, sf):
    e = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("head"), F.lit("in").alias("relation"), F.col("r_name").alias("tail"))
    return readers.graph(e)[0]


@query(
    """select 'line_has_order' as invariant, count(*) as violations from lineitem where l_orderkey not in (select o_orderkey from orders) union all
    select 'order_has_customer', count(*) from orders where o_custkey not in (select c_custkey from customer) union all
    select 'part_key_unique', count(*) from (select p_partkey from part group by 1 having count(*) > 1) union all
    select 'label_has_document', count(*) from labels where doc_id not in (select doc_id from documents) union all
    select 'discount_in_range', count(*) from lineitem where l_discount < 0 or l_discount > 1"""
)
def invariants(spark, sf):
    t = lambda n: table(spark, sf, n)
    return decision.violations(
        line_has_order=t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        order_has_customer=t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        part_key_unique=t("part").groupBy("p_partkey").count().where("count > 1"),
        label_has_document=t("labels").join(t("documents"), "doc_id", "left_anti"),
        discount_in_range=t("lineitem").where("l_discount < 0 or l_discount > 1"),
    )


@query("select s_suppkey, s_nationkey, case when s_acctbal > 5000 then 'new ' || s_name else s_name end as s_name from supplier")
def overlay_join(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    new = table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_suppkey", F.concat(F.lit("new "), "s_name").alias("s_name"))
    return fusion.overlay(s, new, "s_suppkey")


@query("select l_returnflag as branch, l_orderkey, l_linenumber from lineitem where l_returnflag <> 'R' union all select 'R', l_orderkey, 0 from lineitem where l_returnflag = 'R' and l_linenumber = 1")
def splice_branch(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("branch"), "l_orderkey", "l_linenumber")
    return fusion.splice(t, "R", t.where("branch = 'R' and l_linenumber = 1").withColumn("l_linenumber", F.lit(0)))


@query("select c_custkey, c_name from customer where c_custkey > 100 union all select c_custkey, c_name || '*' from customer where c_custkey <= 100 union all select -n_nationkey - 1, n_name from nation")
def upsert_rows(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = old.where("c_custkey <= 100").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"))
    new = new.union(table(spark, sf, "nation").select((-F.col("n_nationkey") - 1).cast("long"), "n_name"))
    return fusion.upsert(old, new, "c_custkey")


@query("select o_orderkey, o_orderstatus = 'F' and o_totalprice > 100000 and o_orderkey % 2 = 0 as promotable from orders")
def promotion_gate(spark, sf):
    levels = F.when(F.col("o_totalprice") > 100000, F.array(F.lit("L1"), F.lit("L2"), F.lit("L3"), F.lit("L4"))).otherwise(F.array(F.lit("L1"), F.lit("L3")))
    return table(spark, sf, "orders").select("o_orderkey", decision.promotable(levels, F.col("o_orderstatus") == "F", F.col("o_orderkey") % 2 == 0).alias("promotable"))


@query()
def table_fingerprint(spark, sf):
    return writers.fingerprint(table(spark, sf, "part"))


@query("select p_partkey, case when p_name ilike '%a%' and p_size % 2 = 0 then 'tab' else '' end as form from part")
def inferred_form(spark, sf):
    name = F.when(F.col("p_name").ilike("%a%") & (F.col("p_size") % 2 == 0), "x tab of 10 tablets").otherwise("x")
    return table(spark, sf, "part").select("p_partkey", parsing.infer_form(name, F.lit(""), True).alias("form"))
