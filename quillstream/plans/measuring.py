"""Metrics, digests and tickets over ``events``, ``labels`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import classify, metrics
from ..session import load
from .registry import query

START, CUT, END = "2024-01-05 00:00:00", "2024-01-15 00:00:00", "2024-01-25 00:00:00"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select count(*) as messages, count(distinct user_id) as people from events where event_type = 'click'")
def metrics_window_totals(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type = 'click'").agg(F.count("*").alias("messages"), F.countDistinct("user_id").alias("people"))


_DAYS = "select strftime(ts + interval '5 hours 30 minutes', '%Y-%m-%d') as day, count(*) as messages, count(distinct user_id) as people from events group by 1"


@query(_DAYS)
def metrics_daily_buckets(spark: SparkSession, d: str) -> DataFrame:
    return metrics.daily(_events(spark, d), F.col("ts"), "user_id")


@query(
    f"""select strftime(c.d, '%Y-%m-%d') as day, strftime(c.d, '%a') as label, coalesce(messages, 0) as messages, coalesce(people, 0) as people
 from (select unnest(generate_series(date '2023-12-25', date '2024-02-10', interval 1 day)) as d) c left join ({_DAYS}) x on x.day = strftime(c.d, '%Y-%m-%d')"""
)
def metrics_calendar_fill(spark: SparkSession, d: str) -> DataFrame:
    return metrics.filled(metrics.daily(_events(spark, d), F.col("ts"), "user_id"), "2023-12-25", "2024-02-10")


@query(
    f"""select messages, people, previous, previous_people, case when previous > 0 then round(100.0 * (messages - previous) / previous, 6) end as delta from (select count(*) filter (ts >= timestamp '{CUT}') as messages, count(distinct case when ts >= timestamp '{CUT}' then user_id end) as people,
 count(*) filter (ts < timestamp '{CUT}') as previous, count(distinct case when ts < timestamp '{CUT}' then user_id end) as previous_people from events where ts >= timestamp '{START}' and ts < timestamp '{END}')"""
)
def metrics_period_delta(spark: SparkSession, d: str) -> DataFrame:
    return metrics.windows(_events(spark, d), F.col("ts"), "user_id", CUT, START, END)


@query(
    """select count(*) as raised, count(*) filter (o_orderstatus is distinct from 'F') as open_now, count(*) filter (o_orderpriority = '1-URGENT') as critical from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'"""
)
def metrics_tickets_range(spark: SparkSession, d: str) -> DataFrame:
    """O-AGG-7; a null status counts as open."""
    rows = load(spark, d, "orders").where("o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
    return rows.agg(F.count("*").alias("raised"), F.count_if(~F.col("o_orderstatus").eqNullSafe("F")).alias("open_now"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("critical"))


@query(
    """with r as (select coalesce(source, 'unmatched') as intent, quality = 1 as up, doc_id from documents join labels using (doc_id)), g as (select intent, count(*) filter (up) as up, count(*) filter (not up) as down from r group by intent),
 f as (select intent, string_agg(doc_id::varchar, ',' order by doc_id) as examples from (select *, row_number() over (partition by intent order by doc_id) as rn from r where not up) where rn <= 3 group by intent)
 select intent, up, down, case when up + down > 0 then round(100.0 * up / (up + down), 6) else 0 end as satisfaction, coalesce(examples, '') as examples from g left join f using (intent)"""
)
def digest_by_intent(spark: SparkSession, d: str) -> DataFrame:
    met = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return metrics.digest(met, F.col("source"), F.col("quality") == 1, "doc_id")


@query("select count(*) as total, count(*) filter (quality = 1) as up, count(*) filter (quality = 0) as down, case when count(*) > 0 then round(100.0 * count(*) filter (quality = 1) / count(*), 6) else 0 end as satisfaction from labels")
def digest_overall(spark: SparkSession, d: str) -> DataFrame:
    """O-AGG-14: zero, not null, when empty."""
    up = F.count_if(F.col("quality") == 1)
    share = F.when(F.count("*") > 0, F.round(100.0 * up / F.count("*"), 6)).otherwise(0.0)
    return load(spark, d, "labels").agg(F.count("*").alias("total"), up.alias("up"), F.count_if(F.col("quality") == 0).alias("down"), share.alias("satisfaction"))


@query("select coalesce(o_orderstatus, 'all') as status, count(*) as n from orders group by rollup (o_orderstatus)")
def tickets_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n")


@query(
    """select o_orderkey, target, priority, confidential from (select o_orderkey, case when o_orderpriority = '5-LOW' then null when sensitive then case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'hr_head' else 'hrbp' end when o_orderpriority = '4-NOT SPECIFIED' then 'hr_ops' else 'hr_ops' end as target,
 case when sensitive then 'critical' else 'normal' end as priority, sensitive as confidential from (select *, o_orderpriority = '1-URGENT' as sensitive from orders))"""
)
def tickets_route(spark: SparkSession, d: str) -> DataFrame:
    route = F.when(F.col("o_orderpriority") == "5-LOW", "elsewhere").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "none").when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), "hr_head").otherwise("hr_ops")
    rows = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("sensitive"), route.alias("route"))
    return classify.routed(rows).select("o_orderkey", "target", "priority", "confidential")


@query("select event_type, count(*) as n, count(distinct user_id) as people, round(max(value), 6) as peak, round(greatest(max(value), 1), 6) as scale, arg_max(event_id, (value, -event_id)) as peak_event from events group by event_type")
def metrics_chart_scale(spark: SparkSession, d: str) -> DataFrame:
    """O-AGG-22."""
    return _events(spark, d).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("people"), F.round(F.max("value"), 6).alias("peak"), F.round(F.greatest(F.max("value"), F.lit(1.0)), 6).alias("scale"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("peak_event")
    )


@query("select user_id, event_type, count(*) as n from events group by grouping sets ((user_id, event_type), (event_type), ())")
def extra_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Spark-native extra."""
    return load(spark, d, "events").groupingSets([["user_id", "event_type"], ["event_type"], []], "user_id", "event_type").agg(F.count("*").alias("n"))


@query()
def extra_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Spark-native extra."""
    return load(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("people"))


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as sid from g)
 select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by user_id, sid"""
)
def extra_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Spark-native extra: gaps of half an hour end a session."""
    s = _events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query(
    f"""with t as (select user_id as thread_id, max(ts) as updated_at from events group by user_id)
 select user_id as thread_id, count(*) as messages from events join t on t.thread_id = user_id where updated_at >= timestamp '{CUT}' and event_type = 'click' and ts >= timestamp '{CUT}' and ts < timestamp '{END}' group by user_id"""
)
def metrics_thread_messages(spark: SparkSession, d: str) -> DataFrame:
    """O-FLT-4: threads whose newest event lies in the window, from rows; ``metrics.messages_between`` reads stored arrays."""
    found = metrics.rows_between(_events(spark, d).select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("role"), F.col("ts").alias("at")), F.lit(CUT).cast("timestamp"), F.lit(END).cast("timestamp"), "click")
    return found.groupBy("thread_id").agg(F.count("*").alias("messages"))


@query("select count(*) as recent from orders where o_orderdate >= date '1998-08-02' - interval 90 day")
def metrics_last_days(spark: SparkSession, d: str) -> DataFrame:
    """O-DAT-7, O-DAT-8."""
    return load(spark, d, "orders").where(values.since_days(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-02").cast("timestamp"), 90)).agg(F.count("*").alias("recent"))
