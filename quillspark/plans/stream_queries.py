"""Rolling and windowed usage over events, and intake that runs once for each content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from ..streaming import intake
from .registry import query, table


def _seconds():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


@query(
    """select event_id, count(*) over w as rolling_count, round(sum(value) over w, 4) as rolling_sum, s - lag(s) over (partition by user_id order by s, event_id) as gap
    from (select *, cast(floor(epoch(ts)) as bigint) as s from events) window w as (partition by user_id order by s range between 3599 preceding and current row)"""
)
def rolling_usage(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("s", _seconds())
    out = ordered.rolling(e, "user_id", F.col("s"), "value", 3600)
    gap = F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("s", "event_id"))
    return out.select("event_id", "rolling_count", F.round("rolling_sum", 4).alias("rolling_sum"), gap.alias("gap"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_usage(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return intake.tumbling(e, "ts", "event_type", "value").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as n from s group by user_id, k"""
)
def user_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = intake.sessions(e, "ts", "user_id", "6 hours")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("select distinct sha256(props) as sha from events")
def intake_once(spark, sf):
    """Intake as a stream that runs over what there is: the stream's state keeps each content once."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/stream"
    base = f"{base}/intake-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    intake.run_available(intake.once(stream, "props").select("sha"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("sha string").parquet(f"{base}/out")


@query("select event_id from events where event_id % 3 <> 0")
def changed_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    done = intake.changed(e, e.select("event_id", F.lit("").alias("row_hash")).limit(0), "event_id").where("event_id % 3 = 0").select("event_id", "row_hash")
    return intake.changed(e, done, "event_id").select("event_id")


@query("select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def unfinished_tasks(spark, sf):
    o = table(spark, sf, "orders")
    return intake.unfinished(o, o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED").alias("status")), "o_orderkey").select("o_orderkey")


@query(
    """with e as (select event_id, user_id, ts, event_type, value from events), p as (select user_id, ts, max(value) as value from e where event_type = 'purchase' group by 1, 2)
    select event_id, (select p.value from p where p.user_id = e.user_id and p.ts <= e.ts order by p.ts desc limit 1) as last_purchase from e where event_type = 'view'"""
)
def as_of_purchase(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return ordered.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), p, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("select p_partkey, n_nationkey from part join nation on p_retailprice >= 900 + n_nationkey * 40 and p_retailprice < 960 + n_nationkey * 40")
def range_join(spark, sf):
    spans = table(spark, sf, "nation").select("n_nationkey", (900 + F.col("n_nationkey") * 40).alias("lo"), (960 + F.col("n_nationkey") * 40).alias("hi"))
    return ordered.range_join(table(spark, sf, "part"), spans, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "n_nationkey")
