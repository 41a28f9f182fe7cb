"""Worked payout examples, to the cent."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstream.operators import pay


@pytest.mark.parametrize(
    "level, target, revenue, retention, rating, company, individual, payout",
    [
        (4, 80_000, "415", "86.7", 5, "0", "104000", "104000"), (8, 100_000, "408", "85.5", 3, "21000", "70000", "91000"), (5, 100_000, "415", "86.7", 4, "20000", "92000", "112000"),
        (7, 100_000, "408", "87.2", 3, "27000", "70000", "97000"), (7, 100_000, None, None, 3, None, "70000", "70000"), (7, 100_000, "413", "86.5", 3, "30000", "70000", "100000"),
    ],
)
def test_variable(spark, level, target, revenue, retention, rating, company, individual, payout):
    people = spark.createDataFrame([(f"X{level}", target, str(rating), "Other")], "grade string, target long, rating string, vertical string")
    r = pay.variable_payout(people, F.lit(revenue).cast(pay.MONEY), F.lit(retention).cast(pay.MONEY)).first()
    assert (r.company, r.individual, r.payout) == tuple(None if x is None else Decimal(x) for x in (company, individual, payout))
    assert r.partial == (revenue is None) and r.reason is None


def test_reasons_and_overrides(spark):
    rows = [("X7", 100, "3", "Sales", None), ("X7", None, "3", "Other", None), ("X7", None, "3", "Other", 50_000), ("", 100, "3", "Other", None), ("X7", 100, "9", "Other", None)]
    people = spark.createDataFrame(rows, "grade string, target long, rating string, vertical string, stated_target long")
    got = [(r.reason, r.payout) for r in pay.variable_payout(people, F.lit("430").cast(pay.MONEY), F.lit("90").cast(pay.MONEY)).collect()]
    assert got[0] == ("excluded", None) and got[1] == ("no target", None) and got[3] == ("no level", None) and got[4] == ("no rating", None)
    assert got[2] == (None, Decimal("53000.00"))


def test_openness_of_bands(spark):
    rows = spark.createDataFrame([(405,), (413,), (430,)], "v int")
    table = pay.bands(spark, "revenue", pay.REVENUE_BANDS)
    value = F.col("v").cast(pay.MONEY)
    assert [r.ord for r in pay.in_band(rows, value, table).orderBy("v").collect()] == [1, 2, 4]
    assert [r.ord for r in pay.in_band(rows, value, table, low_inclusive=False).orderBy("v").collect()] == [0, 1, 3]


def test_components(spark):
    people = spark.createDataFrame([(1, "kam", 80_000)], "id int, role string, target long")
    components = spark.createDataFrame([("kam", "a", 1, 50, "v"), ("kam", "b", 2, 50, "v")], "role string, component string, ord int, weight_pct int, slab string")
    slabs = spark.createDataFrame([("v", "VARIANCE_POINTS", None, -2.0, 0.0), ("v", "VARIANCE_POINTS", -2.0, 0.0, 50.0), ("v", "VARIANCE_POINTS", 0.0, None, 120.0)], "slab string, kind string, lo double, hi double, factor_pct double")
    results = spark.createDataFrame([(1, "a", 2.0), (1, "b", -1.5)], "id int, component string, achieved double")
    r = pay.component_payout(people, components, slabs, results).first()
    assert (r.payout, r.missing) == (Decimal("68000.00"), "")
    r = pay.component_payout(people, components, slabs, results.where("component = 'a'")).first()
    assert (r.payout, r.missing) == (Decimal("48000.00"), "b")
    assert pay.weights_off(components).count() == 0


def test_working(spark):
    rows = [("X7", 100_000, "3", "Other", None), ("X4", 80_000, "5", "Other", None), ("X7", 100_000, "3", "Sales", None), ("X7", None, "4", "Other", 50_000)]
    people = spark.createDataFrame(rows, "grade string, target long, rating string, vertical string, stated_target long")
    money = lambda x: F.lit(x).cast(pay.MONEY)
    full = [r.working for r in pay.working(people, money("408"), money("87.2")).collect()]
    assert full[0].splitlines() == [
        "grade: X7", "target: INR 100,000.00", "weights: company 30%, individual 70%", "company result: revenue 408 pays 0.7x, retention 87.2% pays 1.1x", "rating: 3, up to 100% of the individual share",
        "company share = 30% x (50% x 0.7 + 50% x 1.1) x 100,000.00 = 27,000.00", "individual share = 70% x 100% x 100,000.00 = 70,000.00", "total = 27,000.00 + 70,000.00 = 97,000.00", "a twelfth, not paid monthly: INR 8,083.33",
    ]
    assert "company share = 0% at this grade" in full[1] and full[2] is None and "target: INR 50,000.00 (supposed)" in full[3]
    partial = pay.working(people.limit(1), money(None), money(None)).first().working
    assert "company share = not declared yet" in partial and "total = 0.00 + 70,000.00 = 70,000.00 (individual share only)" in partial and "company result" not in partial
