"""Counts over windows of local days, digests and ticket numbers.

Operators: O-AGG-1 to O-AGG-8, O-AGG-13, O-AGG-14, O-AGG-18 to O-AGG-22, O-FLT-3 to O-FLT-6, O-DAT-1, O-DAT-2, O-WIN-4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

ZONE = "Asia/Kolkata"


def daily(events: DataFrame, ts: Column, who: str, zone: str = ZONE) -> DataFrame:
    """``day, messages, people`` by local day (O-AGG-2)."""
    return events.groupBy(F.date_format(values.local_day(ts, zone), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("messages"), F.countDistinct(who).alias("people"))


def filled(days: DataFrame, first: str, last: str) -> DataFrame:
    """Every day of the span, zeros included, with its short name (O-AGG-3)."""
    span = days.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    met = span.withColumn("day", F.date_format("d", "yyyy-MM-dd")).join(days, "day", "left")
    return met.select("day", F.date_format("d", "E").alias("label"), F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("people", F.lit(0)).alias("people"))


def windows(events: DataFrame, ts: Column, who: str, cut: str, start: str, end: str) -> DataFrame:
    """Totals of two neighbouring half-open windows in one pass, and the change in percent (O-AGG-1, O-AGG-4)."""
    now, before = (ts >= F.lit(cut).cast("timestamp")) & (ts < F.lit(end).cast("timestamp")), (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(cut).cast("timestamp"))
    both = events.where((ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp")))
    sums = both.agg(F.count_if(now).alias("messages"), F.countDistinct(F.when(now, F.col(who))).alias("people"), F.count_if(before).alias("previous"), F.countDistinct(F.when(before, F.col(who))).alias("previous_people"))
    return sums.withColumn("delta", delta(F.col("messages"), F.col("previous")))


def delta(now: Column, before: Column) -> Column:
    """Null without a base."""
    return F.when(before > 0, F.round(100.0 * (now - before) / before, 6))


def resolved_share(escalated: Column, conversations: Column) -> Column:
    """O-AGG-5."""
    return F.when(conversations > 0, F.greatest(F.lit(0.0), 1 - escalated / conversations) * 100)


def digest(ratings: DataFrame, group: Column, up: Column, example: str, most: int = 3) -> DataFrame:
    """``intent, up, down, satisfaction, examples``: the first downvoted examples of each (O-AGG-13, O-SRT-6).

    Examples are the ``most`` smallest, picked by rank before they are gathered, so no group is collected whole.
    """
    named = ratings.select(F.coalesce(group, F.lit("unmatched")).alias("intent"), up.alias("up"), F.col(example).alias("ex"))
    sums = named.groupBy("intent").agg(F.count_if("up").alias("up"), F.count_if(~F.col("up")).alias("down"))
    order = Window.partitionBy("intent").orderBy("ex")
    first = named.where(~F.col("up")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).groupBy("intent").agg(F.array_join(F.sort_array(F.collect_list("ex")), ",").alias("examples"))
    share = F.when(F.col("up") + F.col("down") > 0, F.round(100.0 * F.col("up") / (F.col("up") + F.col("down")), 6)).otherwise(0.0)
    return sums.join(first, "intent", "left").select("intent", "up", "down", share.alias("satisfaction"), F.coalesce("examples", F.lit("")).alias("examples"))


def trailing_count(events: DataFrame, keys: list[str], ts: str, seconds: int = 3600) -> DataFrame:
    """How many events of the key lie in the hour up to each, its lower edge excluded (O-AGG-18, O-WIN-4)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("_us", micros).withColumn("recent", F.count("*").over(Window.partitionBy(*keys).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0))).drop("_us")


def first_spelling(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Case-insensitive distinct that keeps the first spelling (O-AGG-20)."""
    return rows.groupBy(F.lower(name).alias("_k")).agg(F.min_by(name, order).alias(name)).drop("_k")


def messages_between(threads: DataFrame, start: Column, end: Column, role: str = "user") -> DataFrame:
    """Messages of a role in the half-open window, from threads with an array of them (O-FLT-4, O-ARR-1).

    A thread's ``updated_at`` is never before its last message, so older threads go before their arrays are exploded;
    that no optimiser can infer.
    """
    fresh = threads.where(F.col("updated_at") >= start)
    said = fresh.select("thread_id", F.explode("messages").alias("m")).select("thread_id", "m.*")
    return said.where((F.col("role") == role) & (F.col("at") >= start) & (F.col("at") < end))


def rows_between(messages: DataFrame, start: Column, end: Column, role: str = "user") -> DataFrame:
    """The same from one row for each message (thread_id, role, at): the filter reaches the scan, and no array is built.

    A thread with a message in the window was updated since its start, so nothing else has to be asked of it.
    """
    return messages.where((F.col("role") == role) & (F.col("at") >= start) & (F.col("at") < end))


def alerts(denials: DataFrame, who: str, at: str, threshold: int = 3) -> DataFrame:
    """Denials that are at least the ``threshold``-th of their subject within an hour (O-STM-4, O-AGG-18)."""
    return trailing_count(denials.where(F.col(who).isNotNull()), [who], at).where(F.col("recent") >= threshold)
