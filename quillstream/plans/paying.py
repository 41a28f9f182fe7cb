"""Payout queries with TPC-style columns as grades, targets and results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import function_plans, pay
from ..session import load
from .registry import query


@query(
    """select c_custkey, case when v < 405 then 0 when v < 413 then 1 when v < 420 then 2 when v < 430 then 3 else 4 end as band, (case when v < 405 then 0 when v < 413 then 0.7 when v < 420 then 1 when v < 430 then 1.1 else 1.2 end)::double as funding
 from (select c_custkey, (400 + c_custkey % 40)::decimal(18,4) as v from customer)"""
)
def pay_band_join_lo_inclusive(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select("c_custkey", (400 + F.col("c_custkey") % 40).cast(pay.MONEY).alias("v"))
    return pay.in_band(rows, F.col("v"), pay.bands(spark, "revenue", pay.REVENUE_BANDS)).select("c_custkey", F.col("ord").alias("band"), F.col("funding").cast("double").alias("funding"))


@query(
    """select o_orderkey, case when v <= 405 then 0 when v <= 413 then 1 when v <= 420 then 2 when v <= 430 then 3 else 4 end as band from (select o_orderkey, (400 + o_orderkey % 40)::decimal(18,4) as v from orders)"""
)
def pay_band_join_hi_inclusive(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", (400 + F.col("o_orderkey") % 40).cast(pay.MONEY).alias("v"))
    return pay.in_band(rows, F.col("v"), pay.bands(spark, "revenue", pay.REVENUE_BANDS), low_inclusive=False).select("o_orderkey", F.col("ord").alias("band"))


@query("select p_partkey, case when p_size between 0 and 4 then 0 when p_size between 5 and 6 then 20 when p_size between 7 and 9 then 30 when p_size between 10 and 99 then 40 end as company, case when p_size between 0 and 4 then 100 when p_size between 5 and 6 then 80 when p_size between 7 and 9 then 70 when p_size between 10 and 99 then 60 end as individual from part")
def pay_grade_weight(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return load(spark, d, "part").select("p_partkey", pay.weight(size, 2).alias("company"), pay.weight(size, 3).alias("individual"))


def _staff(spark: SparkSession, d: str) -> DataFrame:
    """Customers as staff."""
    return load(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("X"), (F.col("c_custkey") % 13).cast("string")).alias("grade"), F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal").cast(pay.MONEY), 0)).alias("target"),
        (F.col("c_custkey") % 6).cast("string").alias("rating"), F.when(F.col("c_mktsegment") == "BUILDING", "Sales").otherwise("Other").alias("vertical"),
    )


_STAFF = """p as (select c_custkey, c_custkey % 13 as level, case when c_acctbal > 0 then round(c_acctbal::decimal(18,4), 0) end as target, c_custkey % 6 as rating, c_mktsegment = 'BUILDING' as excluded from customer),
 w as (select *, case when level <= 4 then 0 when level <= 6 then 20 when level <= 9 then 30 else 40 end as cw, case when level <= 4 then 100 when level <= 6 then 80 when level <= 9 then 70 else 60 end as iw,
 case rating when 5 then 130 when 4 then 115 when 3 then 100 when 2 then 0 when 1 then 0 end as rp from p),
 r as (select *, case when excluded then 'excluded' when target is null or target <= 0 then 'no target' when rp is null then 'no rating' end as reason from w)"""


@query(
    f"""with {_STAFF}
 select c_custkey, reason, case when reason is null then ((target::bigint * (cw * 85 + iw * rp) + 50) // 100) / 100.0 end as payout from r"""
)
def pay_variable_payout(spark: SparkSession, d: str) -> DataFrame:
    people = _staff(spark, d)
    paid = pay.variable_payout(people, F.lit("415").cast(pay.MONEY), F.lit("86.2").cast(pay.MONEY))
    return paid.select("c_custkey", "reason", F.col("payout").cast("double").alias("payout"))


_CENTS = lambda c: f"format('{{:,}}.{{:02d}}', (({c}) // 100)::bigint, (({c}) % 100)::bigint)"


@query(
    f"""with {_STAFF}, m as (select *, target::bigint * 100 as t, target::bigint * cw * 85 as c, target::bigint * iw * rp as i from r),
 k as (select *, (c + 50) // 100 as cc, (i + 50) // 100 as ic, (c + i + 50) // 100 as pc from m)
 select c_custkey, case when reason is null then concat_ws(chr(10), 'grade: X' || level, 'target: INR ' || {_CENTS("t")}, 'weights: company ' || cw || '%, individual ' || iw || '%', 'company result: revenue 415 pays 1x, retention 86.2% pays 0.7x',
 'rating: ' || rating || ', up to ' || rp || '% of the individual share', case when cw = 0 then 'company share = 0% at this grade' else 'company share = ' || cw || '% x (50% x 1 + 50% x 0.7) x ' || {_CENTS("t")} || ' = ' || {_CENTS("cc")} end,
 'individual share = ' || iw || '% x ' || rp || '% x ' || {_CENTS("t")} || ' = ' || {_CENTS("ic")}, 'total = ' || {_CENTS("cc")} || ' + ' || {_CENTS("ic")} || ' = ' || {_CENTS("pc")}, 'a twelfth, not paid monthly: INR ' || {_CENTS("(pc + 6) // 12")}) end as working from k"""
)
def pay_working(spark: SparkSession, d: str) -> DataFrame:
    """O-PRJ-6: how each payout came about, as text."""
    return pay.working(_staff(spark, d), F.lit("415").cast(pay.MONEY), F.lit("86.2").cast(pay.MONEY)).select("c_custkey", "working")


_COMPONENTS = [("air", "bookings", 1, "60", "grow"), ("air", "margin", 2, "40", "steps"), ("ship", "bookings", 1, "100", "steps")]
_SLABS = [("grow", "MULTIPLIES", None, "50", "0"), ("grow", "MULTIPLIES", "50", "100", "100"), ("grow", "MULTIPLIES", "100", None, "150"), ("steps", "BANDED", None, "20", "0"), ("steps", "BANDED", "20", "60", "80"), ("steps", "BANDED", "60", None, "120")]


@query(
    """with people as (select o_orderkey as id, case when o_orderkey % 2 = 0 then 'air' else 'ship' end as role, round(o_totalprice::decimal(18,4), 0)::bigint as target from orders),
 comp(role, component, ord, weight, slab) as (values ('air', 'bookings', 1, 60, 'grow'), ('air', 'margin', 2, 40, 'steps'), ('ship', 'bookings', 1, 100, 'steps')),
 res as (select l_orderkey as id, case when l_linenumber % 2 = 1 then 'bookings' else 'margin' end as component, (l_quantity * 3)::bigint as achieved from lineitem),
 met as (select p.id, ord, component, target * weight as cents, achieved, slab from people p join comp c using (role) left join res r using (id, component)),
 paid as (select id, ord, component, case when achieved is null then null when slab = 'grow' then (cents * (case when achieved <= 50 then 0 when achieved <= 100 then 100 else 150 end) * achieved + 5000) // 10000 else (cents * (case when achieved <= 20 then 0 when achieved <= 60 then 80 else 120 end) + 50) // 100 end as pay from met)
 select id, sum(coalesce(pay, 0)) / 100.0 as payout, coalesce(string_agg(component, ',' order by ord) filter (pay is null), '') as missing from paid group by id"""
)
def pay_component_payout(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "air").otherwise("ship").alias("role"), F.round(F.col("o_totalprice").cast(pay.MONEY), 0).alias("target"))
    components = spark.createDataFrame(_COMPONENTS, "role string, component string, ord int, weight_pct string, slab string").withColumn("weight_pct", F.col("weight_pct").cast("decimal(9,4)"))
    slabs = spark.createDataFrame(_SLABS, "slab string, kind string, lo string, hi string, factor_pct string")
    slabs = slabs.withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("lo", "hi", "factor_pct")})
    results = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 1, "bookings").otherwise("margin").alias("component"), (F.col("l_quantity") * 3).cast("decimal(18,4)").alias("achieved"))
    return pay.component_payout(people, components, slabs, results).select("id", F.col("payout").cast("double").alias("payout"), "missing")


def _plan_values() -> tuple[str, str, list[str]]:
    """The fixed plan lines as SQL values, and the roles, read by hand for the SQL side."""
    edge, comps, roles = lambda x: "null" if x is None else x, [], []
    bands = []
    for line in function_plans.SLAB_LINES.splitlines():
        plan, slab, kind, body = [x.strip() for x in line.split("|")]
        for i, item in enumerate(body.split(";")):
            label, factor = item.rsplit(":", 1)
            numbers = re.findall(r"-?[0-9.]+", label.replace("–", " to "))
            low, high = (numbers[0], numbers[1]) if len(numbers) == 2 else (None, None) if not numbers else (None, numbers[0]) if re.match(r"\s*(<|≤|below)", label) else (numbers[0], None)
            bands.append(f"('{plan}/{slab}', '{kind}', {edge(low if i else None)}, {edge(high)}, {factor})")
    for line in function_plans.ROLE_LINES.splitlines():
        plan, role, body = [x.strip() for x in line.split("|")]
        roles.append(role)
        for i, item in enumerate(body.split(";")):
            name, rest = item.split("=")
            weight, slab = rest.split(":")
            comps.append(f"('{role}', '{name.strip().lower()}', {i}, {weight}, '{plan}/{slab.strip()}')")
    return ", ".join(bands), ", ".join(comps), roles


_BANDS, _PARTS, _ROLES = _plan_values()
_LISTED = "[" + ", ".join(f"'{r}'" for r in _ROLES) + "]"


@query(
    f"""with slabs(slab, kind, lo, hi, factor) as (values {_BANDS}), comp(role, component, ord, weight, slab) as (values {_PARTS}),
 people as (select c_custkey as id, {_LISTED}[c_custkey % {len(_ROLES)} + 1] as role, (c_custkey % 997 + 1)::bigint * 1000 as target from customer),
 got as (select o_custkey as id, o_orderkey % 4 as ord, (sum(o_orderkey % 200) // count(*))::bigint as a from orders where o_orderkey % 5 > 0 group by 1, 2),
 met as (select p.id, c.ord, c.component, target * weight as cents, a, slab, case when slab like '%grr%' or slab like '%nrr%' or slab like '%margin' then a % 9 - 4 else a end as v from people p join comp c using (role) left join got using (id, ord)),
 paid as (select m.id, m.ord, m.component, case when v is null then null when kind = 'MULTIPLIES' then cents * factor::bigint * v / 10000.0 else cents * factor::bigint / 100.0 end as pay from met m left join slabs s on s.slab = m.slab and (lo is null or v > lo) and (hi is null or v <= hi))
 select id, round(sum(round(coalesce(pay, 0)) / 100.0), 2) as payout, coalesce(string_agg(component, ',' order by ord) filter (pay is null), '') as missing from paid group by id"""
)
def pay_function_plans(spark: SparkSession, d: str) -> DataFrame:
    """O-RUL-4 to O-RUL-6 by the published plans: customers as staff, averages over their orders as results."""
    slab_table = function_plans.intervals(function_plans.lines(spark, function_plans.SLAB_LINES))
    parts = function_plans.components(function_plans.lines(spark, function_plans.ROLE_LINES))
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), (F.col("c_custkey") % len(_ROLES) + 1).cast("int"))
    people = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), role.alias("role"), ((F.col("c_custkey") % 997 + 1) * 1000).cast(pay.MONEY).alias("target"))
    got = load(spark, d, "orders").where("o_orderkey % 5 > 0").groupBy(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("ord")).agg(F.floor(F.sum(F.col("o_orderkey") % 200) / F.count("*")).alias("a"))
    asked = people.join(F.broadcast(parts.select("role", "ord", "component", "slab")), "role").join(got, ["id", "ord"])
    points = F.col("slab").rlike("grr|nrr|margin$")
    results = asked.select("id", "component", F.when(points, F.col("a") % 9 - 4).otherwise(F.col("a")).cast(pay.MONEY).alias("achieved"))
    return function_plans.payouts(people, results, slab_table, parts).select("id", F.col("payout").cast("double").alias("payout"), "missing")
