"""Structured Streaming versions of the event-driven parts.

Operators: O-STM-1, O-STM-3 to O-STM-7, O-WIN-10. Each builder takes and returns a streaming (or static) DataFrame; ``drain``
runs one over all that is there and hands back what it wrote, which batch queries and tests use.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import answers
from ..session import shared_dir

HOLD_BACK, SENTINEL = 90, "NO_ANSWER"


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, be it one file or a folder: the source takes a pattern for either."""
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(f"{folder}/{name}.parque[t]")


def tumbling_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages by local day in +05:30 (O-STM-5)."""
    day = F.window("ts", "1 day", startTime="18 hours 30 minutes")
    return events.withWatermark("ts", late).groupBy(day.alias("w")).agg(F.count("*").alias("messages")).select(F.date_format(F.col("w.end"), "yyyy-MM-dd").alias("day"), "messages")


def trailing_hour(events: DataFrame, slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Sliding hours with three events of a subject or more (O-STM-4)."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 hour", slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.where("n >= 3").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """Count, first and last sight of each subject (O-STM-6)."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def held_back(pieces: DataFrame, key: str = "answer_id", order: str = "seq", piece: str = "piece") -> DataFrame:
    """A stored token stream replayed: what each piece ``released`` and how many characters are shown after it (O-STM-1, O-WIN-10).

    Nothing is shown until ``HOLD_BACK`` characters are there or the answer ends. If they hold the sentinel or a phrase of refusal,
    nothing ever is. Only the held characters of an answer are joined; later pieces pass through by themselves.
    """
    run = F.sum(F.length(piece)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.withColumn("_run", run)
    held = placed.where(F.col("_run") - F.length(piece) < HOLD_BACK).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, piece))).alias("_h"))
    opening = F.array_join(F.transform("_h", lambda x: x[piece]), "")
    held = held.select(key, opening.alias("_opening"), F.element_at("_h", -1)[order].alias("_release"))
    first = F.left("_opening", F.lit(HOLD_BACK))
    met = placed.join(held, key).withColumn("refused", F.contains(first, F.lit(SENTINEL)) | answers.refusal(first))
    released = F.when(F.col("refused"), "").when(F.col(order) == F.col("_release"), F.col("_opening")).when(F.col(order) > F.col("_release"), F.col(piece)).otherwise("")
    chars = F.when(~F.col("refused") & (F.col(order) >= F.col("_release")), F.col("_run")).otherwise(0)
    return met.withColumns({"released": released, "shown_chars": chars.cast("long")}).drop("_run", "_opening", "_release")


def conversation_state(turns: DataFrame) -> DataFrame:
    """User turns and the last question of each conversation, as keyed state (O-STM-7)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, last_turn, last = state.get if state.exists else (0, -1, "")
        for frame in frames:
            user = frame[frame["role"] == "user"]
            asked += len(user)
            if len(user) and int(user["turn"].max()) > last_turn:
                row = user.loc[user["turn"].idxmax()]
                last_turn, last = int(row["turn"]), str(row["text"])
        state.update((asked, last_turn, last))
        yield pd.DataFrame({"conv_id": [key[0]], "asked": [asked], "last_question": [last]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, asked long, last_question string", "asked long, last_turn long, last string", "update", GroupStateTimeout.NoTimeout)


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def data_batches_only(spark: SparkSession) -> Iterator[None]:
    """Queries started within take no batch without data. One whose timers run by the clock would else never find that it has read all there is."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, mode: str, timed: bool = False) -> DataFrame:
    """Run a stream over all there is and return what it wrote: a table of Parquet files, not rows in the driver.

    In complete mode each batch replaces the table, in the other modes it adds to it; a batch that is run again after a
    failure writes its own folder anew. ``timed``: the stream has timers by the clock.
    """
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/table" if mode == "complete" else f"{folder}/table/batch={batch}")

    with data_batches_only(spark) if timed else nullcontext():
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table").select(*stream.columns)
