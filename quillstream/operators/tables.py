"""Sheet and employee ETL: joins to the last detail row, reconciliation, registers, duplicate identities, facts of a person.

Operators: O-JOIN-1 to O-JOIN-5, O-JOIN-13, O-JOIN-17 to O-JOIN-19, O-AGG-15, O-AGG-16, O-AGG-24, O-WIN-2, O-WIN-12, O-PRJ-2, O-PRJ-5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_row(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A later row of the sheet overwrites an earlier one."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def with_details(master: DataFrame, key: str, details: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left join of the last row of each detail sheet, as one struct per sheet; unmatched detail rows are left out (O-JOIN-3)."""
    for name, (rows, order) in details.items():
        one = last_row(rows, key, order)
        master = master.join(one.select(key, F.struct(*[c for c in one.columns if c != key]).alias(name)), key, "left")
    return master


def reconciliation(joined: DataFrame, parts: list[str]) -> DataFrame:
    """How many master rows met each detail (O-AGG-16)."""
    return joined.agg(F.count("*").alias("total"), *[F.count(p).alias(f"with_{p}") for p in parts], *[F.count_if(F.col(p).isNull()).alias(f"without_{p}") for p in parts])


def unknown(details: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """O-JOIN-4."""
    return details.join(master.select(key), key, "left_anti")


def shared_identities(people: DataFrame, code: str, identity: str) -> DataFrame:
    """Identities that more than one person owns (O-AGG-24)."""
    return people.groupBy(identity).agg(F.countDistinct(code).alias("owners")).where("owners > 1")


def register(days: DataFrame, who: str, month: str, code: str) -> DataFrame:
    """Working, present and leave days by month from day codes; months without a working day are dropped (O-AGG-15)."""
    c = F.upper(F.trim(F.coalesce(F.col(code), F.lit(""))))
    working = (c != "") & ~c.isin("WO", "H", "HO")
    sums = days.groupBy(who, month).agg(F.count_if(working).alias("working"), F.count_if(working & ((c == "P") | c.startswith("0.5"))).alias("present"), F.count_if(working & (c == "L")).alias("on_leave"))
    return sums.where("working > 0")


def unfolded(sheet: DataFrame, keys: list[str], day_columns: list[str]) -> DataFrame:
    """Day columns as rows (day, code)."""
    return sheet.unpivot(keys, day_columns, "day", "code")


def month_spans(banner: DataFrame, last_column: int) -> DataFrame:
    """``month, first, last``: a month ends before the next one's banner column (O-WIN-12). One header row's worth of rows."""
    return banner.select("month", F.col("col").alias("first"), (F.coalesce(F.lead("col").over(Window.partitionBy("sheet").orderBy("col")), F.lit(last_column + 1)) - 1).alias("last"))


def leaf(path: Column) -> Column:
    """O-PRJ-5."""
    return F.trim(F.element_at(F.split(path, ">"), -1))


def by_identity(accounts: DataFrame, people: DataFrame) -> DataFrame:
    """Accounts joined to the person who owns their address (O-JOIN-13)."""
    owned = people.select("employee_code", F.explode("identities").alias("email"))
    return accounts.withColumn("email", F.lower("email")).join(owned.withColumn("email", F.lower("email")), "email", "left")


def first_choice(wanted: DataFrame, candidates: DataFrame, priority: Column, key: str) -> DataFrame:
    """Of all candidates of a key the one with the least priority number (O-JOIN-12, O-JOIN-18)."""
    met = wanted.join(candidates, key).withColumn("_p", priority).where(F.col("_p").isNotNull())
    return met.withColumn("_r", F.row_number().over(Window.partitionBy(key, *[c for c in wanted.columns if c != key]).orderBy("_p"))).where("_r = 1").drop("_r", "_p")


def latest_appraisal(reviews: DataFrame, who: str) -> DataFrame:
    """The rated review of the last cycle, by text; of equal cycles the later row (O-WIN-2)."""
    rated = reviews.where(F.trim(F.coalesce("rating", F.lit(""))) != "")
    best = F.max_by(F.struct("cycle", "rating"), F.struct(F.coalesce("cycle", F.lit("")), "ord")).alias("r")
    return rated.groupBy(who).agg(best).select(who, "r.cycle", "r.rating")


def input_of(components: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """``key, component, value``: the input that answers a component (O-JOIN-12): its name, else its slab key, else ``*``, else the
    first input (by ``ord``, then the least value) whose name contains the component's or is contained in it; null where none does."""
    name = F.lower("component")
    label = F.lower(F.trim("input"))
    rule = F.when(label == name, 0).when(label == F.col("slab"), 1).when(label == "*", 2).when(F.contains(name, label) | F.contains(label, name), 3)
    met = components.join(inputs, key).withColumn("p", rule).where("p is not null")
    best = met.groupBy(key, "component").agg(F.min_by("value", F.struct("p", "ord", "value")).alias("value"))
    return components.select(key, "component").join(best, [key, "component"], "left")


def with_published(wanted: DataFrame, stored: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """The stored plan of a key, else the published one (O-JOIN-19): a plan that is absent or cannot be read (null) falls back whole."""
    own, base = stored.select(key, F.col("plan").alias("_own")), published.select(key, F.col("plan").alias("_base"))
    met = wanted.join(own, key, "left").join(base, key, "left")
    return met.select(*wanted.columns, F.coalesce("_own", "_base").alias("plan"), F.col("_own").isNull().alias("is_default"))


def facts(fields: Column, sections: dict[str, list[tuple[str, Column]]]) -> Column:
    """A person's facts as text lines, only of the requested sections and only where there is something to say (O-PRJ-2, O-PRJ-6)."""
    lines = [F.when(F.array_contains(fields, section) & value.isNotNull() & (F.trim(value.cast("string")) != ""), F.concat(F.lit(f"{label}: "), value.cast("string"))) for section, rows in sections.items() for label, value in rows]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")
