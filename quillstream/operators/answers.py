"""From ranked passages to answers: budgets, follow-ups, modes and the extractive answer.

Operators: O-WIN-3, O-WIN-6 to O-WIN-8, O-RUL-8 to O-RUL-11, O-PRJ-4, O-PRJ-7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

CONTEXT_CHARS, LEAST_LEFT, HISTORY_CHARS, TURN_CHARS = 14_000, 200, 60_000, 2_000
MISS, CONFIDENT = 0.34, 0.55


def within_budget(ranked: DataFrame, by: str, body: str, label_length: Column, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Passages in rank order until the budget is used; the last one is cut (O-WIN-7)."""
    before = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(body) + label_length + 12).over(before), F.lit(0))
    left = F.lit(budget) - F.col("_used")
    kept = ranked.withColumn("_used", used).where(left > F.when(F.col("rank") == 1, 0).otherwise(LEAST_LEFT))
    return kept.withColumn("body", F.left(F.col(body), left.cast("int"))).drop("_used")


def recent_history(turns: DataFrame, by: str = "conv_id", order: str = "turn", budget: int = HISTORY_CHARS, each: int = TURN_CHARS) -> DataFrame:
    """Turns, newest first, until the budget overflows, in their order again (O-WIN-8)."""
    cut = turns.withColumn("text", text.clip(F.col("text"), each))
    run = F.sum(F.length("text")).over(Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")


def last_turns(turns: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """O-WIN-6."""
    return turns.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def previous_question(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The nearest earlier user turn of each turn (O-WIN-3)."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def mode(confidence: Column, can_generate: Column, declined: Column) -> Column:
    """O-RUL-9."""
    return F.when(declined, "declined").when(confidence < MISS, "none").when(can_generate, "generated").otherwise("extractive")


def retried(first: Column, second: Column, bare: Column) -> Column:
    """Whether the widened question's result is taken (O-RUL-10)."""
    wants = (first < MISS) | (bare & (first < CONFIDENT))
    return wants & (second >= MISS) & (second > first)


#: Phrases of an answer that says it has none.
REFUSALS = r"\b(i (do not|don't) have|could not find|couldn't find|no information|not (covered|mentioned|available) in)\b"


def refusal(answer: Column) -> Column:
    """O-RUL-11."""
    pattern = "(?i)" + REFUSALS
    return F.contains(answer, F.lit("NO_ANSWER")) | ((F.length(answer) <= 320) & answer.rlike(pattern)) | F.left(answer, F.lit(160)).rlike(pattern)


def label(title: Column, headings: Column) -> Column:
    """O-PRJ-4."""
    return F.concat_ws(" › ", title, F.filter(headings, lambda h: F.trim(h) != ""))


def extractive(confidence: Column, name: Column, passage: Column) -> Column:
    """O-PRJ-7."""
    lead = F.when(confidence >= CONFIDENT, F.lit("Here is what the documents say.")).otherwise(F.lit("This may be related."))
    return F.concat_ws("\n\n", lead, F.concat(F.lit("**"), name, F.lit("**")), text.clip_to_sentence(passage))


def capability(has_model: Column, has_embedder: Column, embedded: Column) -> Column:
    """O-RUL-8."""
    return F.when(has_model & has_embedder & (embedded > 0), "full").when(has_model, "keyword").otherwise("extractive")
