"""Reports: counts with intervals, agreement, profiles, token scores, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import alignment, evaluation, ordered
from .registry import query, table

_W = "({s} * (n / t::double + 1.9208 / t {op} 1.96 * sqrt(n / t::double * (1 - n / t::double) / t + 0.9604 / (t * t::double))) / (1 + 3.8416 / t))"


@query(
    f"""with d(source, i) as (values ('click', 0), ('view', 1), ('refund', 2), ('error', 3)), c as (select event_type, count(*) as k from events group by 1), x as (select source as event_type, coalesce(k, 0) as n, (select count(*) from events)::double as t from d left join c on event_type = source)
    select event_type, n, round(100 * n / t, 1) as pct, round({_W.format(s=100, op='-')}, 1) as ci_low, round({_W.format(s=100, op='+')}, 1) as ci_high from x"""
)
def dense_counts(spark, sf):
    return evaluation.dense_counts(table(spark, sf, "events"), "event_type", ["click", "view", "refund", "error"])


@query("select c_mktsegment, count(*) as n, round(count(*) / (select count(*) from customer)::double, 9) as share, round(avg(case when c_acctbal < 0 then 1.0 else 0.0 end), 9) as debtor_rate, round(avg(case when c_nationkey < 10 then 1.0 else 0.0 end), 9) as near_rate from customer group by 1")
def group_profile(spark, sf):
    c = table(spark, sf, "customer").withColumns({"debtor": F.col("c_acctbal") < 0, "near": F.col("c_nationkey") < 10})
    out = evaluation.group_profile(c, "c_mktsegment", ["debtor", "near"])
    return out.select("c_mktsegment", "n", *(F.round(x, 9).alias(x) for x in ("share", "debtor_rate", "near_rate")))


@query("select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'O') as O, count(*) filter (o_orderstatus = 'P') as P from orders group by 1 having count(*) >= 10")
def crosstab_min_n(spark, sf):
    return evaluation.crosstab(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("select 'all' as cohort, 'urgent' as metric, count(*) filter (o_orderpriority = '1-URGENT') as n from orders union all select 'all', 'large', count(*) filter (o_totalprice > 200000) from orders union all select 'open', 'urgent', count(*) filter (o_orderpriority = '1-URGENT') from orders where o_orderstatus = 'O' union all select 'open', 'large', count(*) filter (o_totalprice > 200000) from orders where o_orderstatus = 'O'")
def coverage_unpivot(spark, sf):
    o = table(spark, sf, "orders").withColumns({"urgent": F.col("o_orderpriority") == "1-URGENT", "large": F.col("o_totalprice") > 200000})
    return evaluation.coverage({"all": o, "open": o.where("o_orderstatus = 'O'")}, ["urgent", "large"])


@query(
    """with c as (select quality as a, toxic as b, count(*) as n from labels where quality is not null and toxic is not null group by 1, 2), t as (select sum(n)::bigint as n, (sum(case when a = b then n else 0 end) / sum(n))::double as po from c),
    e as (select sum(x.n * y.n)::double as s from (select a as v, sum(n) as n from c group by 1) x join (select b as v, sum(n) as n from c group by 1) y using (v))
    select n, round(po, 9) as observed, round(s / (n * n)::double, 9) as expected, round((po - s / (n * n)::double) / (1 - s / (n * n)::double), 9) as kappa from t, e"""
)
def rater_kappa(spark, sf):
    out = evaluation.kappa(table(spark, sf, "labels").where("quality is not null and toxic is not null"), "quality", "toxic")
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


@query("select l_returnflag, sum(case when l_linestatus = 'F' then l_quantity end) as F, sum(case when l_linestatus = 'O' then l_quantity end) as O from lineitem group by 1")
def pivot_quantity(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))


@query("select o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 6) as q1, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as q3, min(o_totalprice) as least, max(o_totalprice) as most from orders group by 1")
def quantiles(spark, sf):
    q = F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = table(spark, sf, "orders").groupBy("o_orderpriority").agg(q.alias("q"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))
    return out.select("o_orderpriority", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))), "least", "most")


@query("select p_name, count(*) as n, row_number() over (order by count(*) desc, p_name) as position from part group by 1")
def long_tail(spark, sf):
    return evaluation.long_tail(table(spark, sf, "part"), "p_name")


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(
    f"""with p as (select a.conv_id as id, a.text as x, b.text as y from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = 0 and b.turn = 1),
    t as (select id, w, sum(a) as a, sum(b) as b from (select id, unnest({_TOK.format('x')}) as w, 1 as a, 0 as b from p union all select id, unnest({_TOK.format('y')}), 0, 1 from p) group by 1, 2),
    s as (select id, sum(least(a, b))::double as c, sum(a)::double as n, sum(b)::double as m, count(*) filter (regexp_matches(w, '^[0-9]+$') and a > 0)::double as k, count(*) filter (regexp_matches(w, '^[0-9]+$') and a > 0 and b > 0) as kf from t group by 1)
    select id, round(case when m = 0 then 0 else c / m end, 9) as precision, round(case when n = 0 then 0 else c / n end, 9) as recall, round(case when c = 0 then 0 else 2 * c / (n + m) end, 9) as f1, round(case when k = 0 then 0 else kf / k end, 9) as number_recall from s"""
)
def token_scores(spark, sf):
    c = table(spark, sf, "conversations")
    first, second = c.where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("x")), c.where("turn = 1").select(F.col("conv_id").alias("id"), F.col("text").alias("y"))
    out = evaluation.token_scores(first.join(second, "id"), "id", text.word_tokens(F.col("x")), text.word_tokens(F.col("y")))
    return out.select("id", *(F.round(n, 9).alias(n) for n in ("precision", "recall", "f1", "number_recall")))


@query(
    """with p as (select a.p_name as x, b.p_name as y from (select distinct p_name from part) a join (select distinct p_name from part) b on substr(a.p_name, 1, 3) = substr(b.p_name, 1, 3))
    select x, y, round(case when length(x) = 0 then (case when length(y) = 0 then 0 else 1 end) else levenshtein(x, y) / length(x)::double end, 9) as cer from p"""
)
def character_error_rate(spark, sf):
    n = table(spark, sf, "part").select("p_name").distinct()
    pairs = n.select(F.col("p_name").alias("x")).withColumn("k", F.substring("x", 1, 3)).join(n.select(F.col("p_name").alias("y")).withColumn("k", F.substring("y", 1, 3)), "k")
    return pairs.select("x", "y", F.round(similarity.character_error_rate(F.col("x"), F.col("y")), 9).alias("cer"))


@query(
    """with c as (select l_returnflag, l_linestatus, sum(l_discount) as s, count(l_discount) as n from lineitem group by 1, 2), l as (select l_returnflag, l_linestatus, s, n from c union all select 'ALL', l_linestatus, s, n from c), p as (select l_returnflag, l_linestatus, sum(s) / sum(n) as mean from l group by 1, 2)
    select l_returnflag, round(avg(mean), 9) as macro from p group by 1"""
)
def macro_average(spark, sf):
    return evaluation.macro(table(spark, sf, "lineitem"), "l_linestatus", "l_discount", "l_returnflag").select("l_returnflag", F.round("macro", 9).alias("macro"))


@query("select count(*) filter (event_type = 'click') as tp, count(*) filter (event_type = 'view') as fp, round(count(*) filter (event_type = 'click') / count(*) filter (event_type in ('click', 'view'))::double, 9) as precision, round(count(*) filter (event_type = 'click') / count(*) filter (event_type in ('click', 'error'))::double, 9) as recall from events")
def precision_recall(spark, sf):
    of = lambda e: F.count_if(F.col("event_type") == e)
    one = table(spark, sf, "events").agg(of("click").alias("tp"), of("view").alias("fp"), of("error").alias("fn"))
    scores = evaluation.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return one.select("tp", "fp", F.round(scores["precision"], 9).alias("precision"), F.round(scores["recall"], 9).alias("recall"))


@query(
    """select l_linenumber, round(count(*) filter (l_tax > 0.02 and l_discount > 0.02) / count(*) filter (l_tax > 0.02)::double, 9) as recall, round(count(*) filter (l_tax > 0.02 and l_discount > 0.02) / count(*) filter (l_tax > 0.02 or l_discount > 0.02)::double, 9) as iou from lineitem group by 1"""
)
def mask_agreement(spark, sf):
    cells = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_tax") > 0.02).alias("truth"), (F.col("l_discount") > 0.02).alias("found"))
    return evaluation.mask_agreement(cells, "l_linenumber").select("l_linenumber", F.round("recall", 9).alias("recall"), F.round("iou", 9).alias("iou"))


@query("with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as p, count(*) over () as t from orders), i as (select range as i from range(100)) select o_orderkey from n join i on p = floor(i * t / 100::double)::bigint")
def systematic_sample(spark, sf):
    return ordered.systematic(table(spark, sf, "orders"), "o_orderkey", 100).select("o_orderkey")


@query("select o_orderkey, turn, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as turn from orders) order by turn, o_orderpriority limit 37")
def round_robin(spark, sf):
    return ordered.round_robin(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 37).select("o_orderkey", "turn", "o_orderpriority")


@query("with s as (select *, row_number() over (partition by o_orderstatus order by sha256(o_orderkey || '|42')) as nth, count(*) over (partition by o_orderstatus) as size, count(*) over () as t from orders) select o_orderkey, o_orderstatus from s where nth <= greatest(1, floor(size * 50 / t::double))")
def stratified_sample(spark, sf):
    return ordered.stratified(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 50).select("o_orderkey", "o_orderstatus")


@query(
    """with a as (select o_orderkey, 'urgent' as stratum, 0 as i from orders where o_orderpriority = '1-URGENT' order by o_orderkey limit 10), b as (select o_orderkey, 'large' as stratum, 1 as i from orders where o_totalprice > 100000 order by o_orderkey limit 10),
    u as (select o_orderkey, arg_min(stratum, i) as stratum, min(i) as i from (select * from a union all select * from b) group by 1), f as (select * from u union all (select o_orderkey, 'fill', 2 from orders where o_orderkey not in (select o_orderkey from u) order by o_orderkey limit 30))
    select o_orderkey, stratum from f order by i, o_orderkey limit 30"""
)
def quota_sample(spark, sf):
    o = table(spark, sf, "orders")
    return ordered.quota(o, "o_orderkey", [("urgent", F.col("o_orderpriority") == "1-URGENT", 10), ("large", F.col("o_totalprice") > 100000, 10)], 30).select("o_orderkey", "stratum")


@query("select o_orderkey, case when (row_number() over (partition by o_custkey order by o_orderkey) - 1) % 5 = 0 and count(*) over (partition by o_custkey) >= 5 then 'val' else 'dev' end as split from orders")
def every_fifth_split(spark, sf):
    return ordered.every_fifth(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "split")


@query("select doc_id, source from (select *, row_number() over (partition by text order by doc_id) as n from documents) where n = 1")
def dedupe_keep_first(spark, sf):
    return ordered.keep_first(table(spark, sf, "documents"), ["text"], ["doc_id"]).select("doc_id", "source")


@query("with w as (select doc_id, lang <> 'en' as is_ref, min(case when lang = 'en' then doc_id end) over (partition by source, n_chars % 50) as f from documents) select doc_id from w where not is_ref or f is null or f > doc_id")
def copy_dedupe(spark, sf):
    d = table(spark, sf, "documents").withColumn("signature", F.concat_ws("|", "source", (F.col("n_chars") % 50).cast("string")))
    return ordered.copies(d, "signature", "doc_id", F.col("lang") != "en").select("doc_id")


@query("select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as n from lineitem) where n <= 2")
def head_per_group(spark, sf):
    return ordered.head(table(spark, sf, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 2).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def anti_join(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 300000")
    return table(spark, sf, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select l_returnflag, l_linestatus, sum(l_quantity) as quantity, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_quantity(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


def _turns(spark, sf):
    """All pieces of a conversation's first two turns, whole: the first turn's are truths, the second's findings."""
    c = table(spark, sf, "conversations")
    lines = c.where("turn < 2").select(F.col("conv_id").alias("doc"), F.when(F.col("turn") == 0, "truth").otherwise("found").alias("side"), F.posexplode(F.split("text", r"[.\n]+")).alias("position", "text"))
    return lines.select("doc", "side", F.col("position").cast("long").alias("position"), F.trim("text").alias("text"))


@query()
def optimal_alignment(spark, sf):
    return alignment.optimal(_turns(spark, sf)).withColumn("score", F.round("score", 6))


@query()
def greedy_alignment(spark, sf):
    return alignment.greedy(_turns(spark, sf), least=40.0).withColumn("score", F.round("score", 6))


@query()
def best_evidence(spark, sf):
    return alignment.best_evidence(_turns(spark, sf)).withColumn("score", F.round("score", 6))


@query("select o_custkey, max(o_orderkey) filter (n = 1) as first_order, max(o_orderkey) filter (n = m) as last_order from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n, count(*) over (partition by o_custkey) as m from orders) group by 1")
def first_and_last(spark, sf):
    key = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(key)["o_orderkey"].alias("first_order"), F.max(key)["o_orderkey"].alias("last_order"))


