"""Banded payouts in exact decimals.

Operators: O-JOIN-9 to O-JOIN-12, O-MTH-5, O-RUL-1 to O-RUL-4, O-AGG-21, O-AGG-25, O-PRJ-6. Band, weight and slab tables are
literals of a plan; their sizes do not depend on the data, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import percent_of

MONEY, WIDE = "decimal(18,4)", "decimal(38,10)"
# The company-wide plan.
LEVEL_WEIGHTS = ((0, 4, 0, 100), (5, 6, 20, 80), (7, 9, 30, 70), (10, 99, 40, 60))
RATING_PAYOUT = {"5": 130, "4": 115, "3": 100, "2": 0, "1": 0}
REVENUE_BANDS, RETENTION_BANDS = ("405", "413", "420", "430"), ("85", "86.5", "87", "87.5")
FUNDING, SPLIT = ("0", "0.7", "1", "1.1", "1.2"), ("0.5", "0.5")
EXCLUDED_VERTICALS = ("Sales",)
# End of fixed values.


def bands(spark: SparkSession, name: str, edges: tuple[str, ...], funding: tuple[str, ...] = FUNDING) -> DataFrame:
    rows = [(name, i, lo, hi, f) for i, (lo, hi, f) in enumerate(zip((None, *edges), (*edges, None), funding))]
    return spark.createDataFrame(rows, "metric string, ord int, lo string, hi string, funding string").select("metric", "ord", F.col("lo").cast(MONEY).alias("lo"), F.col("hi").cast(MONEY).alias("hi"), F.col("funding").cast("decimal(9,4)").alias("funding"))


def in_band(rows: DataFrame, value: Column, table: DataFrame, low_inclusive: bool = True) -> DataFrame:
    """Left range join to [lo, hi) (O-JOIN-9) or (lo, hi] (O-JOIN-10); an open end has no bound. Bands do not overlap."""
    lo, hi = F.col("lo"), F.col("hi")
    inside = (lo.isNull() | (value >= lo)) & (hi.isNull() | (value < hi)) if low_inclusive else (lo.isNull() | (value > lo)) & (hi.isNull() | (value <= hi))
    return rows.join(F.broadcast(table), inside, "left")


def band_funding(value: Column, edges: tuple[str, ...], funding: tuple[str, ...] = FUNDING) -> Column:
    """The same lookup as an expression, for few bands; null without a value."""
    out = F.when(value.isNull(), F.lit(None).cast("decimal(9,4)"))
    for edge, f in zip(reversed(edges), reversed(funding)):
        out = out.when(value >= F.lit(edge).cast(MONEY), F.lit(f).cast("decimal(9,4)"))
    return out.otherwise(F.lit(funding[0]).cast("decimal(9,4)"))


def level_of(grade: Column) -> Column:
    """The digits of a grade."""
    return F.regexp_extract(grade, "([0-9]+)", 1).try_cast("int")


def weight(level: Column, part: int) -> Column:
    """Company (2) or individual (3) weight in percent of a level (O-JOIN-11)."""
    out = F.lit(None).cast("int")
    for row in LEVEL_WEIGHTS:
        out = F.when(level.between(row[0], row[1]), row[part]).otherwise(out)
    return out


def variable_payout(people: DataFrame, revenue: Column, retention: Column) -> DataFrame:
    """``company, individual, payout, partial, reason`` (O-RUL-1 to O-RUL-3). Columns: grade, target, rating, vertical; stated_* override (O-RUL-2)."""
    has = lambda c: F.col(f"stated_{c}") if f"stated_{c}" in people.columns else F.lit(None)
    target = F.coalesce(has("target"), F.col("target")).cast(MONEY)
    rating, level = F.coalesce(has("rating"), F.col("rating")).cast("string"), level_of(F.coalesce(has("grade"), F.col("grade")))
    factor = F.create_map(*[F.lit(x) for k, v in RATING_PAYOUT.items() for x in (k, v)])
    rating_share = F.try_element_at(factor, rating)
    reason = F.when(F.col("vertical").isin(*EXCLUDED_VERTICALS), "excluded").when(target.isNull() | (target <= 0), "no target").when(level.isNull(), "no level").when(rating_share.isNull(), "no rating")
    fund = (F.lit(SPLIT[0]).cast("decimal(9,4)") * band_funding(revenue, REVENUE_BANDS) + F.lit(SPLIT[1]).cast("decimal(9,4)") * band_funding(retention, RETENTION_BANDS)).cast(WIDE)
    declared = revenue.isNotNull() & retention.isNotNull()
    company = F.when(declared & (weight(level, 2) != 0), (weight(level, 2).cast(WIDE) / 100 * fund * target).cast(WIDE)).when(weight(level, 2) == 0, F.lit(0).cast(WIDE))
    individual = (weight(level, 3).cast(WIDE) / 100 * (rating_share.cast(WIDE) / 100) * target).cast(WIDE)
    paid = F.round(F.coalesce(company, F.lit(0).cast(WIDE)) + individual, 2)
    ok = F.col("reason").isNull()
    out = people.withColumns({"reason": reason, "company": F.round(company, 2), "individual": F.round(individual, 2), "payout": paid, "partial": ~declared & (weight(level, 2) != 0)})
    return out.withColumns({c: F.when(ok, F.col(c)) for c in ("company", "individual", "payout", "partial")})


def component_payout(people: DataFrame, components: DataFrame, slabs: DataFrame, results: DataFrame) -> DataFrame:
    """``id, payout, missing``: per component weight, achievement and slab (O-RUL-4, O-AGG-25).

    people: id, role, target. components: role, component, ord, weight_pct, slab. slabs: slab, kind, lo, hi, factor_pct.
    results: id, component, achieved. MULTIPLIES pays factor times achievement, the other kinds the factor.
    """
    named = people.join(F.broadcast(components), "role").join(results, ["id", "component"], "left")
    a = F.col("achieved")
    inside = (F.col("slab") == F.col("s.slab_name")) & (F.col("s.lo").isNull() | (a > F.col("s.lo"))) & (F.col("s.hi").isNull() | (a <= F.col("s.hi")))
    met = named.join(F.broadcast(slabs.withColumnRenamed("slab", "slab_name")).alias("s"), inside, "left")
    share = percent_of(F.col("target").cast(MONEY), F.col("weight_pct"))  # rounded before the factor
    factor = F.col("factor_pct").cast(WIDE) / 100
    pay = F.when(F.col("kind") == "MULTIPLIES", (share * factor * a / 100).cast(WIDE)).otherwise((share * factor).cast(WIDE))
    pay = F.when(F.col("factor_pct").isNotNull() & a.isNotNull(), F.round(pay, 2))
    gone = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(pay.isNull(), F.struct("ord", "component")))), lambda x: x["component"]), ",")
    return met.groupBy("id").agg(F.round(F.sum(F.coalesce(pay, F.lit(0).cast(MONEY))), 2).alias("payout"), gone.alias("missing"))


def weights_off(components: DataFrame) -> DataFrame:
    """Roles whose weights do not add up to a hundred (O-AGG-21)."""
    return components.groupBy("role").agg(F.sum("weight_pct").alias("total")).where("total <> 100")


def _money(c: Column) -> Column:
    return F.format_number(c, 2)


def _plain(c: Column) -> Column:
    """A number without the zeros behind its last digit."""
    digits = c.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def working(people: DataFrame, revenue: Column, retention: Column, unit: str = "INR") -> DataFrame:
    """``people`` with ``working``: how a payout came about, line by line (O-PRJ-6); null where none was worked out.

    Lines that do not apply are left out: the company's result where there is none, its share where the level gives it no weight or where
    the result is not declared yet, and then the total is called partial.
    """
    paid = variable_payout(people, revenue, retention)
    stated = lambda c: F.col(f"stated_{c}").isNotNull() if f"stated_{c}" in people.columns else F.lit(False)
    used = lambda c: F.coalesce(F.col(f"stated_{c}"), F.col(c)) if f"stated_{c}" in people.columns else F.col(c)
    target, rating, level = used("target").cast(MONEY), used("rating").cast("string"), level_of(used("grade"))
    mine, ours = weight(level, 3), weight(level, 2)
    share = F.try_element_at(F.create_map(*[F.lit(x) for kv in RATING_PAYOUT.items() for x in kv]), rating)
    declared = revenue.isNotNull() & retention.isNotNull()
    company = F.coalesce("company", F.lit(0).cast(WIDE))
    percent, said = lambda c: F.concat(_plain(c), F.lit("%")), F.concat
    funds = [_plain(band_funding(revenue, REVENUE_BANDS)), _plain(band_funding(retention, RETENTION_BANDS))]
    lines = [
        said(F.lit("grade: "), used("grade"), F.when(stated("grade"), " (supposed)").otherwise("")),
        said(F.lit(f"target: {unit} "), _money(target), F.when(stated("target"), " (supposed)").otherwise("")),
        said(F.lit("weights: company "), percent(ours), F.lit(", individual "), percent(mine)),
        F.when(declared, said(F.lit("company result: revenue "), _plain(revenue), F.lit(" pays "), funds[0], F.lit("x, retention "), percent(retention), F.lit(" pays "), funds[1], F.lit("x"))),
        said(F.lit("rating: "), rating, F.lit(", up to "), percent(share), F.lit(" of the individual share")),
        F.when(ours == 0, F.lit("company share = 0% at this grade")).when(~declared, F.lit("company share = not declared yet")).otherwise(
            said(F.lit("company share = "), percent(ours), F.lit(f" x ({_share(SPLIT[0])} x "), funds[0], F.lit(f" + {_share(SPLIT[1])} x "), funds[1], F.lit(") x "), _money(target), F.lit(" = "), _money(company))
        ),
        said(F.lit("individual share = "), percent(mine), F.lit(" x "), percent(share), F.lit(" x "), _money(target), F.lit(" = "), _money(F.col("individual"))),
        said(F.lit("total = "), _money(company), F.lit(" + "), _money(F.col("individual")), F.lit(" = "), _money(F.col("payout")), F.when(F.col("partial"), " (individual share only)").otherwise("")),
        said(F.lit(f"a twelfth, not paid monthly: {unit} "), _money(F.round(F.col("payout") / 12, 2))),
    ]
    return paid.withColumn("working", F.when(F.col("reason").isNull(), F.concat_ws("\n", *lines)))


def _share(part: str) -> str:
    return f"{float(part) * 100:g}%"
