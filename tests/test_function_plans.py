"""The published plans against their worked examples; the grammar and its checks."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import function_plans, pay

EXAMPLES = [
    ("us-sales-ic", 120000, {"Net New MRR target": 150}, 270000), ("us-sales-ic", 120000, {"net new mrr target": 60}, 72000), ("us-sales-ic", 120000, {"net new mrr target": 200}, 360000),
    ("us-kam-ic", 80000, {"grr target": 2, "nrr target": -1.5}, 68000),
    ("us-sales-partnership-tm", 150000, {"mrr through enterprise deals": 96, "mrr through new industry traction": 96, "partner pipeline origination": 100}, 180750),
    ("us-presales-ic", 70000, {"net mrr target": 110, "pipeline to closure conversion": 30}, 91000),
    ("us-partnership-ic", 60000, {"partner pipeline origination target (mrr)": 90, "partner sourced & influenced revenue (mrr)": 90, "partner network addition (quantity)": 80}, 65550),
    ("in-sales-ic", 1000000, {"net new mrr target": 200, "service sales — blended hourly rate": 0}, 2700000), ("in-cp-ic", 100000, {"nrr target": 2}, 120000), ("in-cp-ic", 100000, {"nrr target": -3}, 0),
    ("ps-manager", 200000, {"billable utilisation (team-aggregate)": 78, "on-time completion of new onboarding": 92, "all work delivered within budgeted hours": 95}, 162500), ("csm-ic", 600000, {"grr target": 2}, 720000),
]


@pytest.fixture(scope="module")
def tables(spark):
    return function_plans.intervals(function_plans.lines(spark, function_plans.SLAB_LINES)), function_plans.components(function_plans.lines(spark, function_plans.ROLE_LINES))


def test_worked_examples(spark, tables):
    people = spark.createDataFrame([(i, role, float(t)) for i, (role, t, _, _) in enumerate(EXAMPLES)], "id int, role string, target double")
    results = spark.createDataFrame([(i, c, float(v)) for i, (_, _, got, _) in enumerate(EXAMPLES) for c, v in got.items()], "id int, component string, achieved double").withColumn("achieved", F.col("achieved").cast(pay.MONEY))
    paid = {r.id: r for r in function_plans.payouts(people, results, *tables).collect()}
    assert [float(paid[i].payout) for i in range(len(EXAMPLES))] == [float(x[3]) for x in EXAMPLES]
    assert paid[10].missing == "churn during implementation (team-aggregate)" and paid[0].missing == ""


def test_plans_are_whole(tables):
    slabs, parts = tables
    assert function_plans.faults(slabs).count() == 0 and parts.where("fault is not null").count() == 0
    assert parts.select("role").distinct().count() == 23 and pay.weights_off(parts).count() == 0
    assert parts.join(slabs, ["plan", "slab"], "left_anti").count() == 0


def test_faults(spark):
    text = """p | gap | BANDED | <10%: 0; 20–30%: 50; >30%: 100
p | overlap | BANDED | 0–40%: 0; >30–50%: 50; >50%: 100
p | short | POINTS | −2 to −1: 5; -1 to 3.5: 7
p | floating | BANDED | >5: 1; above 9: 2
p | words | BANDED | some: 1; >5%: many; all: 3
p | kind | ODD | all: 1
p | none | BANDED |
nonsense"""
    table = function_plans.intervals(function_plans.lines(spark, text))
    got = {(r.slab, r.ord, r.fault) for r in function_plans.faults(table).collect()}
    assert {("gap", 1, "gap"), ("overlap", 1, "overlap"), ("short", 1, "open above"), ("floating", 0, "open below"), ("floating", 1, "overlap"), ("words", 0, "label not understood"), ("words", 1, "factor not understood"), ("kind", 0, "unknown kind"), ("none", None, "no bands"), (None, None, "no slab")} == got
    assert [(r.lo, float(r.hi)) for r in table.where("slab = 'short' and ord = 0").collect()] == [(None, -1.0)]
