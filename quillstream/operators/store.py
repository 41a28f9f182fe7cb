"""Upserts, patches, versions and cascades as DataFrame rewrites of a table.

Operators: O-SNK-1 to O-SNK-14, O-WIN-5, O-SET-2. A rewritten table goes out through Spark's commit protocol
(O-SNK-5, O-SNK-13).
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """O-SNK-1."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def patched(rows: DataFrame, new: DataFrame, key: str, column: str, flag: str) -> DataFrame:
    """New values where there are any, and a flag that says so (O-SNK-2)."""
    more = new.withColumnRenamed(column, "_new")
    met = rows.join(more, key, "left")
    return met.withColumn(flag, F.col(flag) | F.col("_new").isNotNull()).withColumn(column, F.coalesce("_new", column)).drop("_new")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """O-SNK-3."""
    return rows.join(gone.select(key), key, "left_anti")


def newest(rows: DataFrame, keys: list[str], order: list[str], exempt: Column) -> DataFrame:
    """The newest row of each key, and all that are exempt (O-SNK-4, O-WIN-5).

    An aggregate that combines on the map side finds the newest, so that a key with a third of all rows is no window of its own.
    """
    others = [c for c in rows.columns if c not in keys]
    kept = F.coalesce(exempt, F.lit(False))
    best = rows.withColumn("_exempt", kept).groupBy(*keys).agg(F.max_by(F.struct(*others, "_exempt"), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return best.where("not _exempt").select(*rows.columns).unionByName(rows.where(kept))


def last_write(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """O-SNK-6, as an aggregate that combines on the map side."""
    others = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_r")
    return rows.groupBy(key).agg(best).select(key, "_r.*")


def logins(events: DataFrame, key: str, at: str, name: Column, code: Column) -> DataFrame:
    """First and last sight, count, latest known name and code (O-SNK-7)."""
    latest = lambda c: F.max_by(c, F.when(c.isNotNull() & (F.trim(c) != ""), F.col(at)))
    return events.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"), latest(name).alias("name"), latest(code).alias("code"))


def with_fallback(new: DataFrame, current: DataFrame, key: str, plain: list[str]) -> DataFrame:
    """Blank fields keep their current value; the ``plain`` ones are overwritten even with null (O-SNK-11)."""
    n, c = new.alias("n"), current.alias("c")
    field = lambda x: F.col(f"n.{x}") if x in plain else F.coalesce(F.nullif(F.trim(F.col(f"n.{x}").cast("string")), F.lit("")).cast(new.schema[x].dataType), F.col(f"c.{x}"))
    return n.join(c, F.col(f"n.{key}") == F.col(f"c.{key}"), "left").select(F.col(f"n.{key}"), *[field(x).alias(x) for x in new.columns if x != key])


def synced_threads(threads: DataFrame, owner: str, most: int = 20) -> DataFrame:
    """Rows with an id, stamped with their owner, the first ``most`` in input order (O-SNK-10)."""
    return threads.where(F.trim(F.coalesce("id", F.lit(""))) != "").withColumn("owner", F.lit(owner)).orderBy("ord").limit(most)


def with_comment(tickets: DataFrame, comments: DataFrame) -> DataFrame:
    """Append a comment struct to the ticket's array (O-SNK-12)."""
    met = tickets.join(comments.select("id", F.col("comment").alias("_c")), "id", "left")
    return met.withColumn("comments", F.when(F.col("_c").isNull(), F.col("comments")).otherwise(F.array_append(F.coalesce("comments", F.array().cast(tickets.schema["comments"].dataType)), F.col("_c")))).drop("_c")


def audit_event(actor: Column, action: Column, target: Column, detail: Column) -> Column:
    """O-SNK-8: the detail is cut to 400 characters, the cut marked."""
    return F.struct(actor.alias("actor"), action.alias("action"), target.alias("target"), text.clip(detail, 400).alias("detail"))


def access_event(subject: Column, code: Column, outcome: Column, intent: Column, fields: Column, question: Column, thread: Column) -> Column:
    """O-SNK-9: no fields are an empty list, the question is cut to 300 characters, the cut marked."""
    return F.struct(
        subject.alias("subject"), code.alias("employee_code"), outcome.alias("outcome"), intent.alias("intent"),
        F.coalesce(fields, F.array().cast("array<string>")).alias("fields"), text.clip(question, 300).alias("question"), thread.alias("thread_id"),
    )


def append(events: DataFrame, folder: str) -> bool:
    """Append events to a table; a failure is logged and reported, and does not reach the caller's own work (O-SNK-8, O-SNK-9)."""
    try:
        events.write.mode("append").parquet(folder)
        return True
    except Exception:
        logging.getLogger(__name__).exception("events were not written to %s", folder)
        return False
