"""Streaming jobs run over the stored tables to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import understanding
from ..session import load
from ..streaming import jobs, stateful, upserts
from .registry import query


def _events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select strftime(ts + interval '5 hours 30 minutes', '%Y-%m-%d') as day, count(*) as messages from events group by 1")
def stream_tumbling_day(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.tumbling_day(_events(spark, d)), "complete")


@query(
    """select user_id, strftime(w, '%Y-%m-%d %H:%M:%S') as started, count(*) as n from (select user_id, time_bucket(interval '15 minutes', ts) - to_minutes(15 * i) as w from events, (select unnest(range(4)) as i)) group by user_id, w having count(*) >= 3"""
)
def stream_trailing_hour(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.trailing_hour(_events(spark, d)), "complete")


@query("select user_id, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at from events group by user_id")
def stream_upsert_state(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return jobs.drain(jobs.latest_state(_events(spark, d)), "complete").select("user_id", "n", day("first_at"), day("last_at"))


@query(
    """select conv_id as answer_id, turn as seq, case when length(so_far) >= 90 or turn = last_turn then length(so_far) else 0 end as shown_chars from (select conv_id, turn, string_agg(text, '') over (partition by conv_id order by turn rows between unbounded preceding and current row) as so_far, max(turn) over (partition by conv_id) as last_turn from conversations)"""
)
def stream_token_holdback(spark: SparkSession, d: str) -> DataFrame:
    """Turns as the pieces of an answer, on a stream; the stored table tells which piece is the last."""
    ends = load(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("end"))
    turns = jobs.stream_of(spark, d, "conversations").join(ends, "conv_id")
    pieces = turns.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), F.col("text").alias("piece"), (F.col("turn") == F.col("end")).alias("last"), F.lit(False).alias("cancel"))
    return jobs.drain(stateful.held_back_stream(pieces), "append", timed=True).where("kind = 'piece'").select("answer_id", "seq", "shown_chars")


@query(
    "select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as recent from events where event_type = 'error' qualify recent >= 3"
)
def stream_denial_alerts(spark: SparkSession, d: str) -> DataFrame:
    denials = _events(spark, d).where("event_type = 'error'")
    return jobs.drain(stateful.denial_alerts(denials), "update").groupBy("user_id", "event_id").agg(F.max("recent").alias("recent"))


@query("select user_id, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at from events where user_id is not null group by user_id")
def stream_upsert_table(spark: SparkSession, d: str) -> DataFrame:
    """O-STM-6, O-SNK-1: the stream merged into a bucketed table."""
    folder = jobs._folder(spark)
    table = upserts.sightings(spark, f"{folder}/table")
    table.stream(_events(spark, d).select("user_id", "ts"), f"{folder}/checkpoint").awaitTermination()
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return table.read().select("user_id", "n", shown("first_at"), shown("last_at"))


@query()
def stream_dialogue(spark: SparkSession, d: str) -> DataFrame:
    """O-CLS-7 over all turns: what each user turn does in its conversation."""
    return jobs.drain(stateful.dialogue(signals(jobs.stream_of(spark, d, "conversations"))), "append", timed=True)


def signals(turns: DataFrame) -> DataFrame:
    """Turns with what the words of a message say: misconduct, a record asked for, and a question long enough to search by."""
    turns = turns.select("conv_id", "turn", "role", "text", text.normalize(F.col("text")).alias("raw"))
    turns = turns.withColumn("kind", understanding.sensitive_kind(F.col("raw"), F.col("raw")))
    low, none = F.lower(F.coalesce("text", F.lit(""))), F.lit(None)
    grave = F.coalesce("kind.hard", F.lit(False))
    words = F.size(text.tokenize(F.col("text")))
    kinds = {
        "decision": F.when(grave, "sensitive").when(words < 3, "escalate").otherwise("answer"), "intent": F.when(grave, F.col("kind.intent")).otherwise("policy"), "confidence": F.least(F.lit(1.0), words / 10),
        "route": F.when(grave, understanding.route_of(F.col("kind.intent"))).otherwise("hr_ops"), "soft": F.coalesce(~F.col("kind.hard"), F.lit(False)), "record": low.rlike(r"\bmy (leave|payslip|balance|attendance)\b"),
        "covered": words >= 3, "options": none.cast("string"),
    }
    return turns.select("conv_id", "turn", "role", "text", *[c.alias(n) for n, c in kinds.items()])


@query("select conv_id, count(*) filter (role = 'user') as asked, coalesce(arg_max(text, turn) filter (role = 'user'), '') as last_question from conversations group by conv_id")
def stream_conversation_state(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.conversation_state(jobs.stream_of(spark, d, "conversations")), "update")
