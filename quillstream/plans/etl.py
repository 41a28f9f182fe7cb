"""ETL queries: ``customer`` as the master sheet, ``orders`` and ``events`` as detail sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store, tables
from ..session import load
from .registry import query


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders)
 select count(*) as total, count(o.o_orderkey) as with_comp, count(n_name) as with_place, count(*) - count(o.o_orderkey) as without_comp, count(*) - count(n_name) as without_place from customer c left join o on o.o_custkey = c_custkey and r = 1 left join nation on n_nationkey = c_nationkey and n_nationkey < 20"""
)
def etl_left_join_report(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    master = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    joined = tables.with_details(master, "id", {"comp": (orders, "o_orderkey")})
    places = load(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.struct("n_name").alias("place"))
    return tables.reconciliation(joined.join(F.broadcast(places), "c_nationkey", "left"), ["comp", "place"])  # a fixed list of nations


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def etl_unmatched_ids(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.unknown(load(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("select event_type || ':' || (event_id % 97)::varchar as identity, count(distinct user_id) as owners from events group by 1 having count(distinct user_id) > 1")
def etl_duplicate_identity(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "events").select("user_id", F.concat_ws(":", "event_type", (F.col("event_id") % 97).cast("string")).alias("identity"))
    return tables.shared_identities(people, "user_id", "identity")


@query(
    """with c as (select user_id, strftime(ts, '%Y-%m') as month, case event_type when 'click' then 'P' when 'view' then 'L' when 'purchase' then '0.5P' when 'scroll' then 'WO' else '' end as code from events)
 select * from (select user_id, month, count(*) filter (code <> '' and code not in ('WO', 'H', 'HO')) as working, count(*) filter (code = 'P' or code like '0.5%') as present, count(*) filter (code = 'L') as on_leave from c group by user_id, month) where working > 0"""
)
def etl_unpivot_register(spark: SparkSession, d: str) -> DataFrame:
    """Day codes by event type, laid out as a sheet of four columns and unfolded again."""
    codes = {"click": "P", "view": "L", "purchase": "0.5P", "scroll": "WO"}
    sheet = _events(spark, d).select("event_id", "user_id", F.date_format("ts", "yyyy-MM").alias("month"), *[F.when(F.col("event_type") == k, F.lit(v)).alias(k) for k, v in codes.items()])
    days = tables.unfolded(sheet, ["event_id", "user_id", "month"], list(codes))
    return tables.register(days, "user_id", "month", "code")


@query("select user_id, event_type, round(value, 6) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def etl_last_row_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    return store.last_write(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_type", F.round("value", 6).alias("value"))


@query(
    """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at, count(*) as n, arg_max(event_type, event_id) filter (event_type <> 'view') as name, arg_max(event_id, event_id) filter (value > 0.5) as code from events group by user_id"""
)
def etl_login_rollup(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("event_type") != "view", F.col("event_type"))
    code = F.when(F.col("value") > 0.5, F.col("event_id").cast("string"))
    rows = store.logins(_events(spark, d), "user_id", "event_id", named, code)
    times = _events(spark, d).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.join(times, "user_id").select("user_id", day("a").alias("first_at"), day("b").alias("last_at"), "n", "name", F.col("code").cast("long").alias("code"))


@query(
    """select c_custkey, case when c_acctbal < 0 then 'overdrawn' when c_acctbal < 1000 then 'low' else 'fine' end as state, coalesce(n_name, 'unknown') as place, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as segment from customer left join nation on n_nationkey = c_nationkey"""
)
def etl_projected_master(spark: SparkSession, d: str) -> DataFrame:
    """O-JOIN-1, O-PRJ-1."""
    nations = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    state = F.when(F.col("c_acctbal") < 0, "overdrawn").when(F.col("c_acctbal") < 1000, "low").otherwise("fine")
    segment = F.concat(F.upper(F.left("c_mktsegment", F.lit(1))), F.lower(F.substring("c_mktsegment", 2, 99)))
    return load(spark, d, "customer").join(F.broadcast(nations), "c_nationkey", "left").select("c_custkey", state.alias("state"), F.coalesce("n_name", F.lit("unknown")).alias("place"), segment.alias("segment"))


@query("select o.o_orderkey, coalesce(o.o_orderpriority, '') as priority, case when l.l_orderkey is null then 'sent' else 'stored' end as history from orders o left join (select distinct l_orderkey from lineitem where l_returnflag = 'R') l on l.l_orderkey = o.o_orderkey")
def etl_stored_or_sent(spark: SparkSession, d: str) -> DataFrame:
    """O-JOIN-17: the stored thread where there is one, else what was sent."""
    stored = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("stored").alias("h")).distinct()
    met = load(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(stored, "o_orderkey", "left")
    return met.select("o_orderkey", F.coalesce("o_orderpriority", F.lit("")).alias("priority"), F.coalesce("h", F.lit("sent")).alias("history"))


@query(
    """select o_custkey, cycle, rating from (select *, row_number() over (partition by o_custkey order by cycle desc, o_orderkey desc) as r from
 (select o_custkey, o_orderkey, 'FY ' || extract(year from o_orderdate) as cycle, case when o_orderpriority = '5-LOW' then ' ' else o_orderpriority end as rating from orders) where trim(rating) <> '') where r = 1"""
)
def etl_latest_appraisal(spark: SparkSession, d: str) -> DataFrame:
    """O-WIN-2."""
    rating = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority"))
    reviews = load(spark, d, "orders").select("o_custkey", F.concat(F.lit("FY "), F.year("o_orderdate").cast("string")).alias("cycle"), rating.alias("rating"), F.col("o_orderkey").alias("ord"))
    return tables.latest_appraisal(reviews, "o_custkey")


_INPUTS = {1: "bookings ", 2: "steps", 3: "*", 4: "margin", 5: "gross margin uplift", 6: "other"}


@query(
    """with c(component, slab) as (values ('Bookings', 'grow'), ('Gross Margin', 'steps'), ('NPS', 'nps')),
 i as (select l_orderkey as id, l_linenumber as ord, l_quantity::double as value, case l_linenumber when 1 then 'bookings' when 2 then 'steps' when 3 then '*' when 4 then 'margin' when 5 then 'gross margin uplift' when 6 then 'other' end as label from lineitem),
 m as (select id, ord, value, component, case when label = lower(component) then 0 when label = slab then 1 when label = '*' then 2 when contains(lower(component), label) or contains(label, lower(component)) then 3 end as p from i cross join c),
 best as (select *, row_number() over (partition by id, component order by p, ord, value) as r from m where p is not null)
 select o_orderkey as id, c.component, value from orders cross join c left join best b on b.id = o_orderkey and b.component = c.component and r = 1"""
)
def etl_component_inputs(spark: SparkSession, d: str) -> DataFrame:
    """O-JOIN-12."""
    names = F.create_map(*[x for n, label in _INPUTS.items() for x in (F.lit(n), F.lit(label))])
    inputs = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").cast("double").alias("value"), F.try_element_at(names, F.col("l_linenumber").cast("int")).alias("input"))
    known = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(s).alias("slab")) for c, s in (("Bookings", "grow"), ("Gross Margin", "steps"), ("NPS", "nps"))]))
    components = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), known.alias("c")).select("id", "c.*")
    return tables.input_of(components, inputs, "id")


@query("""select c_custkey, case when c_mktsegment = 'BUILDING' then 'own plan' else 'standard ' || lower(c_mktsegment) end as plan, c_mktsegment <> 'BUILDING' as is_default from customer where c_mktsegment is not null""")
def etl_plan_or_published(spark: SparkSession, d: str) -> DataFrame:
    """O-JOIN-19: one plan is stored, one stored plan cannot be read, the others are published ones."""
    wanted = load(spark, d, "customer").where("c_mktsegment is not null").select("c_custkey", "c_mktsegment")
    stored = spark.createDataFrame([("BUILDING", "own plan"), ("MACHINERY", None)], "c_mktsegment string, plan string")
    published = wanted.select("c_mktsegment").distinct().withColumn("plan", F.concat(F.lit("standard "), F.lower("c_mktsegment")))
    return tables.with_published(wanted, stored, published, "c_mktsegment").select("c_custkey", "plan", "is_default")


@query(
    """select c_custkey, concat_ws(chr(10), case when c_custkey % 3 <> 1 and trim(c_name) <> '' then 'Name: ' || c_name end, case when c_custkey % 3 <> 1 and trim(c_mktsegment) <> '' then 'Segment: ' || c_mktsegment end,
 case when c_custkey % 3 <> 0 and c_acctbal is not null then 'Balance: ' || c_acctbal::decimal(18,2) end) as facts from customer"""
)
def etl_facts(spark: SparkSession, d: str) -> DataFrame:
    """O-PRJ-2."""
    fields = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("employment"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("compensation"))).otherwise(F.array(F.lit("employment"), F.lit("compensation")))
    sections = {"employment": [("Name", F.col("c_name")), ("Segment", F.col("c_mktsegment"))], "compensation": [("Balance", F.col("c_acctbal").cast("decimal(18,2)"))]}
    return load(spark, d, "customer").select("c_custkey", tables.facts(fields, sections).alias("facts"))
