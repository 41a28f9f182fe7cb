"""Pay plans of functions as text: a small grammar read into interval and component tables, checked, and paid by (O-RUL-4 to O-RUL-6, O-JOIN-10, O-JOIN-18, O-AGG-21).

A slab line is ``plan | slab | kind | label: factor; label: factor; ...``. A label gives the edges of a band: ``0–40%``, ``>40–80%``, ``-2 to -1``,
``<25%`` or ``below -2``, ``>120%`` or ``above 5``, ``all``. The lowest band is open below. Bands are (low, high]. A role line is
``plan | role | component=weight:slab; ...``. Parsing is done by ``Column`` expressions over a table of lines, so plans of any number come in
at once, and what cannot be read is a row of ``faults`` and fails nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pay

# The published plans.
RETENTION_IC = "below -2: 0; -2 to -1: 50; -1 to 1: 100; 1 to 3: 120; 3 to 5: 135; above 5: 150"
RETENTION_HEAD = "below -2: 0; -2 to -0.5: 50; -0.5 to 1: 100; 1 to 3: 120; 3 to 5: 135; above 5: 150"
SLAB_LINES = f"""us | mrr-a | MULTIPLIES | 0–40%: 50; >40–80%: 100; >80–120%: 125; >120%: 150
us | mrr-b | MULTIPLIES | 0–40%: 50; >40–90%: 100; >90–120%: 120; >120%: 150
us | grr-ic | POINTS | {RETENTION_IC}
us | grr-fh | POINTS | {RETENTION_HEAD}
us | nrr-ic | POINTS | {RETENTION_IC}
us | nrr-fh | POINTS | {RETENTION_HEAD}
us | conversion | BANDED | below 25%: 0; above 25%: 100
us | prorated | MULTIPLIES | all: 100
india-sales | mrr | MULTIPLIES | 0–40%: 50; >40–90%: 100; >90–120%: 120; >120%: 150
india-sales | nrr-ic | POINTS | {RETENTION_IC}
india-sales | nrr-fh | POINTS | {RETENTION_HEAD}
india-sales | service-sales | BANDED | ≤80%: 0; >80–90%: 75; >90–105%: 100; >105%: 120
india-sales | conversion | BANDED | <25%: 0; 25–40%: 100; >40%: 100
ps-csm | utilisation | BANDED | <60%: 0; 60–<65%: 50; 65–<75%: 100; 75–80%: 110; >80%: 120
ps-csm | on-time | BANDED | <80%: 0; 80–90%: 75; >90–95%: 100; >95%: 120
ps-csm | budgeted-hours | BANDED | <90%: 125; 90–<100%: 115; 100–<110%: 100; 110–120%: 80; >120–125%: 50; >125%: 0
ps-csm | impl-churn | BANDED | 0–2.5%: 100; >2.5–5%: 50; >5%: 0
ps-csm | ps-margin | POINTS | <-25%: 0; -25 to -15%: 50; >-15 to -5%: 75; >-5 to 5%: 100; >5%: 120
ps-csm | grr-ic | POINTS | {RETENTION_IC}
ps-csm | grr-fh | POINTS | {RETENTION_HEAD}"""
ROLE_LINES = """us | us-sales-ic | Net New MRR target=100:mrr-a
us | us-sales-fh | Net New MRR target=80:mrr-b; NRR=20:nrr-fh
us | us-sales-partnership-tm | MRR through Enterprise deals=45:mrr-a; MRR through New industry traction=45:mrr-a; Partner pipeline origination=10:mrr-a
us | us-kam-ic | GRR target=50:grr-ic; NRR target=50:nrr-ic
us | us-kam-manager | GRR target=50:grr-ic; NRR target=50:nrr-ic
us | us-kam-fh | GRR target=50:grr-fh; NRR target=50:nrr-fh
us | us-partnership-ic | Partner pipeline origination target (MRR)=55:mrr-a; Partner sourced & influenced revenue (MRR)=35:mrr-a; Partner network addition (quantity)=10:prorated
us | us-presales-ic | Net MRR target=80:mrr-a; Pipeline to Closure Conversion=20:conversion
us | us-presales-manager | Net MRR target=80:mrr-a; Pipeline to Closure Conversion=20:conversion
india-sales | in-sales-ic | Net New MRR target=90:mrr; Service Sales — Blended Hourly Rate=10:service-sales
india-sales | in-sales-manager | Net New MRR target=80:mrr; Pipeline to Closure Conversion=10:conversion; Service Sales — Blended Hourly Rate=10:service-sales
india-sales | in-sales-fh | Net New MRR target=80:mrr; Pipeline to Closure Conversion=10:conversion; Service Sales — Blended Hourly Rate=10:service-sales
india-sales | in-sales-cp-ic | Net New MRR target=70:mrr; NRR target (existing book)=20:nrr-ic; Service Sales — Blended Hourly Rate=10:service-sales
india-sales | in-cp-ic | NRR target=100:nrr-ic
india-sales | in-presales-ic | Net MRR target=80:mrr; Pipeline to Closure Conversion=20:conversion
india-sales | in-sdr-ic | Pipeline Origination target=80:mrr; Prepipe-to-Pipe Conversion=20:conversion
india-sales | in-partnership-ic | Pipeline Origination target=25:mrr; MRR Origination target (partner-sourced only)=75:mrr
ps-csm | ps-ic | Billable Utilisation of available time=100:utilisation
ps-csm | ps-manager | Billable Utilisation (team-aggregate)=25:utilisation; On-time Completion of new onboarding=25:on-time; All work delivered within budgeted hours=25:budgeted-hours; Churn during implementation (team-aggregate)=25:impl-churn
ps-csm | ps-fh | Billable Utilisation (BU-level)=25:utilisation; All work delivered within budgeted hours=25:budgeted-hours; Churn during implementation=25:impl-churn; PS Margin=25:ps-margin
ps-csm | csm-ic | GRR target=100:grr-ic
ps-csm | csm-manager | GRR target (team)=100:grr-ic
ps-csm | csm-fh | GRR target (team)=100:grr-fh"""
# End of fixed values.

_NUMBER = "-?[0-9]+(?:\\.[0-9]+)?"
KINDS = ("MULTIPLIES", "BANDED", "POINTS")


def lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text.splitlines() if x.strip()], "line string")


def _fields(line: Column) -> Column:
    return F.transform(F.split(line, "\\|"), lambda x: F.trim(x))


def _items(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, ";"), lambda x: F.trim(x)), lambda x: x != "")


def intervals(texts: DataFrame) -> DataFrame:
    """``plan, slab, kind, ord, label, lo, hi, factor_pct, fault`` of slab lines (line)."""
    f = texts.select(_fields(F.col("line")).alias("f"), "line")
    rows = f.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("plan", "slab", "kind"))], F.posexplode_outer(_items(F.get("f", F.lit(3)))).alias("ord", "item"), "line")
    number = lambda text, pattern: F.regexp_extract(text, pattern, 1).try_cast(pay.MONEY)
    rows = rows.withColumns({"label": F.trim(F.regexp_extract("item", "^(.*):[^:]*$", 1)), "factor_pct": number(F.col("item"), f":\\s*({_NUMBER})\\s*%?\\s*$")})
    # One form for all labels: no blanks and percent signs, one minus, a tilde between two edges.
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.lower("label"), "−%", "-"), "\\s+to\\s+[>≥]?|\\s*–\\s*", "~"), "\\s", "")
    two, below, above = f"^[>≥]?({_NUMBER})~[<≤]?({_NUMBER})$", f"^(?:<|≤|below)({_NUMBER})$", f"^(?:>|≥|above|from)({_NUMBER})$"
    both, every = plain.rlike(two), plain == "all"
    read = both | plain.rlike(below) | plain.rlike(above) | every
    hi = F.when(both, F.regexp_extract(plain, two, 2).try_cast(pay.MONEY)).otherwise(number(plain, below))
    fault = F.when(F.col("slab").isNull() | (F.col("slab") == ""), "no slab").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind").when(F.col("item").isNull(), "no bands")
    fault = fault.when(~F.coalesce(read, F.lit(False)), "label not understood").when(F.col("factor_pct").isNull(), "factor not understood")
    rows = rows.withColumns({"lo": F.when(both, number(plain, two)).otherwise(number(plain, above)), "hi": hi, "fault": fault})
    lowest = (F.row_number().over(Window.partitionBy("plan", "slab").orderBy(F.asc_nulls_first("lo"), "ord")) == 1) & both & F.col("fault").isNull()
    return rows.withColumn("lo", F.when(~lowest, F.col("lo"))).select("plan", "slab", "kind", "ord", "label", "lo", "hi", "factor_pct", "fault")


def faults(table: DataFrame) -> DataFrame:
    """``plan, slab, ord, fault``: what was not read, and where the bands of a slab leave a gap, overlap or do not reach to infinity."""
    order = Window.partitionBy("plan", "slab").orderBy(F.asc_nulls_first("lo"), F.asc_nulls_last("hi"), "ord")
    good = table.where("fault is null").withColumns({"_before": F.lag("hi").over(order), "_n": F.row_number().over(order), "_last": F.lead("ord").over(order).isNull()})
    reach = F.when(F.col("_n") == 1, F.when(F.col("lo").isNotNull(), "open below")).when(F.col("_before").isNull() | F.col("lo").isNull(), "overlap").when(F.col("lo") > F.col("_before"), "gap").when(F.col("lo") < F.col("_before"), "overlap")
    found = good.select("plan", "slab", "ord", F.explode(F.array_compact(F.array(reach, F.when(F.col("_last") & F.col("hi").isNotNull(), "open above")))).alias("fault"))
    return table.where("fault is not null").select("plan", "slab", "ord", "fault").unionByName(found)


def components(texts: DataFrame) -> DataFrame:
    """``plan, role, ord, component, weight_pct, slab, fault`` of role lines (line)."""
    f = texts.select(_fields(F.col("line")).alias("f"))
    rows = f.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("plan", "role"))], F.posexplode_outer(_items(F.get("f", F.lit(2)))).alias("ord", "item"))
    form = f"^(.+)=\\s*({_NUMBER})\\s*:\\s*([^:\\s]+)$"
    part = lambda i: F.regexp_extract("item", form, i)
    fault = F.when(F.col("item").isNull() | ~F.col("item").rlike(form), "component not understood")
    return rows.select("plan", "role", "ord", F.trim(part(1)).alias("component"), part(2).try_cast("decimal(9,4)").alias("weight_pct"), part(3).alias("slab"), fault.alias("fault"))


def payouts(people: DataFrame, results: DataFrame, slab_table: DataFrame, component_table: DataFrame) -> DataFrame:
    """``id, payout, missing`` for people (id, role, target) and results (id, component in any letter case, achieved); roles are unique over plans."""
    keyed = lambda df: df.where("fault is null").withColumn("slab", F.concat_ws("/", "plan", "slab"))
    named = keyed(component_table).select("role", F.lower("component").alias("component"), "ord", "weight_pct", "slab")
    return pay.component_payout(people, named, keyed(slab_table).select("slab", "kind", "lo", "hi", "factor_pct"), results.withColumn("component", F.lower("component")))
