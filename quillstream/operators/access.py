"""Permissions, row visibility and audit reads.

Operators: O-FLT-1, O-FLT-2, O-FLT-7, O-FLT-10 to O-FLT-13, O-JOIN-5, O-AGG-17, O-SET-1 to O-SET-5, O-SRT-3 to O-SRT-5, O-CLS-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUEUE, SENSITIVE = "tickets.queue", "tickets.sensitive"


def permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """``email, permissions``: the sorted union over a user's existing roles (O-AGG-17, O-JOIN-5)."""
    assigned = users.select("email", F.explode("roles").alias("name"))
    held = assigned.join(roles.select("name", F.explode("permissions").alias("p")), "name").select("email", "p").distinct()
    return held.groupBy("email").agg(F.array_sort(F.collect_list("p")).alias("permissions"))


def existing_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    return users.select("email", F.explode("roles").alias("name")).join(roles.select("name"), "name", "left_semi").select("email", "name")


def visible(tickets: DataFrame, me: str | None, mine: set[str]) -> DataFrame:
    """The tickets that a signed-in user may read (O-FLT-10); without a user, all."""
    if me is None:
        return tickets
    own = F.lower("raised_by") == me.lower()
    if QUEUE not in mine:
        return tickets.where(own)
    return tickets if SENSITIVE in mine else tickets.where(~F.col("confidential") | own)


def is_admin(permission_array: Column, area: str) -> Column:
    """O-SET-3."""
    return F.size(F.array_intersect(permission_array, F.array(F.lit("console"), F.lit(area)))) == 2


def clamp(n: int | None, default: int = 200, most: int = 1000) -> int:
    """O-SRT-4."""
    return default if n is None or n < 1 else min(n, most)


def recent(rows: DataFrame, at: str, tie: str, limit: int | None = None, **equal: str) -> DataFrame:
    """The newest rows with the given values (O-SRT-3, O-FLT-1)."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(clamp(limit))


def named(people: DataFrame, columns: list[str], mentions: list[str], limit: int = 20) -> DataFrame:
    """Rows of which a column equals a mention in any case (O-FLT-7); the limit is the operator's own."""
    low = [m.lower() for m in mentions]
    any_of = F.lit(False)
    for c in columns:
        any_of = any_of | F.lower(c).isin(*low)
    return people.where(any_of).orderBy(columns[0]).limit(max(1, limit))


def rejected(assigned: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Names that the catalogue does not know (O-SET-5)."""
    return assigned.join(catalogue.select(key), key, "left_anti")


def can_revoke(actor: Column, target: Column) -> Column:
    """O-FLT-13."""
    return F.lower(actor) != F.lower(target)


def listed(roles: DataFrame) -> DataFrame:
    """Built-in roles first, then by name (O-SRT-5)."""
    return roles.orderBy(F.desc("built_in"), "name")


def shown(tickets: DataFrame, status: str = "all", sensitive: bool = False) -> DataFrame:
    """The filters of the ticket lists (O-FLT-11): ``open`` is all that is not resolved, null included; sensitive is priority critical."""
    if status == "open":
        tickets = tickets.where(~F.col("status").eqNullSafe("resolved"))
    elif status != "all":
        tickets = tickets.where(F.col("status") == status)
    return tickets.where(F.col("priority") == "critical") if sensitive else tickets


def grants_console(role_names: Column, roles: DataFrame) -> Column:
    """Whether any of the names is a role with the console permission; ``roles`` is a literal table of at most some dozens (O-JOIN-20)."""
    names = [r.name for r in roles.where(F.array_contains("permissions", "console")).select("name").limit(1000).collect()]
    return F.arrays_overlap(role_names, F.array(*[F.lit(n) for n in names]).cast("array<string>"))
