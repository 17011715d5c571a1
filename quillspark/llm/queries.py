"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets, url_filter
from .additive_ann import nearest
from .bpe import encode_decode, section_tokens
from .common import table
from .html_text import extract
from .near_dedup import near_duplicates
from .packing import pack
from .pii import personal_data
from .quality import quality_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query
def op3_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.createDataFrame(url_filter.HOST_RULES, "verdict string, rule string")
    patterns = spark.createDataFrame(url_filter.PATTERN_RULES, "verdict string, pattern string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), hosts, patterns)


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query
def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


@query
def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
#: Every rule against every url, without an index.
ORACLE_SQL["op4_url_filter"] = f"""
with u as (select page_id, coalesce(url, '') as url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from pages),
r(rule, suffix, prefix, verdict) as (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
p(verdict, pattern) as (values ('block', '{_HOST}ads-track\\.'), ('block', '{_HOST}adult-x\\.'), ('block', '{_HOST}casino\\.'), ('block', '/login(?:[^a-z0-9_.%-]|$)'), ('block', '/cart(?:[^a-z0-9_.%-]|$)'), ('block', '/track/.*/click(?:[^a-z0-9_.%-]|$)'), ('allow', '{_HOST}adult-education\\.')),
f as (select *, row_number() over (partition by url order by length(rule) desc, length(suffix) desc) as n from (select distinct url, rule, suffix, verdict from u join r on (host = suffix or ends_with(host, '.' || suffix)) and starts_with(path, prefix))),
m as (select url, min(p.verdict) as verdict from u join p on regexp_matches(low, pattern) group by url)
select page_id, host, path, f.rule, coalesce(f.verdict, m.verdict, 'allow') as verdict from u left join f on f.url = u.url and n = 1 left join m on m.url = u.url
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: All pairs that share a shingle, and whatever they reach.
ORACLE_SQL["op5_minhash_near_dedup"] = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from d),
x as (select doc_id, len(g) as n, unnest(g) as shingle from s),
p as (select a.doc_id as i, b.doc_id as j from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e as (select i, j from p union all select j, i from p),
r(i, c) as (select doc_id, doc_id from s union select e.j, r.c from r join e on e.i = r.i and r.c < e.j),
c as (select i, min(c) as component_id from r group by 1)
select doc_id, cast(len(g) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join c on c.i = s.doc_id
"""



def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern with their places: the lengths of matches and of what lies between them add up."""
    quoted = pattern.replace("'", "''")
    return f"""select doc_id, repository, owner, '{kind}' as kind, cast(x.a as bigint) as start, cast(x.a + x.n as bigint) as stop, x.v as value from (select doc_id, repository, owner,
    unnest(list_transform(range(1, len(m) + 1), lambda k: {{'a': list_sum(list_transform(gaps[1:k], lambda t: length(t))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda t: length(t))), 0), 'n': length(m[k]), 'v': v[k]}})) as x
    from (select doc_id, repository, owner, regexp_extract_all(t, '{quoted}', 1) as m, regexp_extract_all(t, '{quoted}', {group}) as v, string_split_regex(t, '{quoted}') as gaps from t) where len(m) > 0) where length(x.v) >= {least}"""


_ALL_SPANS = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, place){}, '')"
#: Every candidate of every text with the owners and repositories that its value has in the corpus.
ORACLE_SQL["op1_secret_scan"] = f"""
with t as (select doc_id, coalesce(text, '') as t, coalesce(concat_ws('/', source, lang), '') as repository, coalesce(source, '') as owner from documents),
base as ({' union all '.join(_sql_spans(*k) for k in secrets.KINDS)}),
g as ({_sql_spans('generic', secrets.GENERIC, 1, 20)}),
alone as (select * from g where regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and not exists (select 1 from base b where b.doc_id = g.doc_id and b.start < g.stop and g.start < b.stop)),
c as (select *, true as own from base union all select *, false from alone),
o as (select value, count(distinct owner) as n_owners, count(distinct owner || chr(0) || repository) as n_repositories from c group by 1),
j as (select c.*, n_owners, n_repositories, case kind when 'assign' then 1 when 'access' then 2 when 'hex' then 3 else 4 end as place, case when n_owners > {secrets.MAX_OWNERS} or n_repositories > {secrets.MAX_REPOSITORIES} then 'copied' when len(list_distinct(string_split(value, ''))) >= {secrets.DISTINCT} and not regexp_matches(value, '{secrets._PLACEHOLDER}') then 'live' else 'unlikely' end as verdict from c join o using (value)),
k as (select * from j where own or verdict = 'live'),
a as (select doc_id, {', '.join(f"count(*) filter (own and kind = '{k[0]}') as n_{k[0]}" for k in secrets.KINDS)}, {_ALL_SPANS.format(' filter (own)')} as written, {_ALL_SPANS.format('')} as spans, count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'copied') as n_copied, max(n_owners) as most_owners, max(n_repositories) as most_repositories from k group by 1)
select t.doc_id, {', '.join(f"coalesce(n_{k[0]}, 0) as n_{k[0]}" for k in secrets.KINDS)}, sha256(coalesce(written, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied, coalesce(most_owners, 0) as most_owners, coalesce(most_repositories, 0) as most_repositories from t left join a using (doc_id)
"""
