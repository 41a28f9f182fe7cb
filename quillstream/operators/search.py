"""Lexical, dense and hybrid search over passages, for batches of questions.

Operators: O-AGG-9 to O-AGG-12, O-JOIN-1, O-JOIN-2, O-JOIN-6 to O-JOIN-8, O-JOIN-14, O-MTH-1 to O-MTH-4, O-WIN-1,
O-SRT-1, O-SRT-7, O-FLT-8, O-FLT-9. Scores are rounded to nine places before they are compared, so that the order
in which Spark adds does not decide a rank. Postings are joined on the term: a question meets only the passages
that share a term with it, and no pair is formed otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values

K1, B, SATURATION, UNSEEN_IDF = 1.4, 0.72, 7.0, 1.2
FLOOR, TOP_K, DENSE_LIMIT, DENSE_FLOOR = 0.02, 14, 200, 0.32
DENSE_WEIGHT, LEXICAL_WEIGHT, SHARE, FOREIGN_PLAN = 0.62, 0.38, 0.75, 0.4


def postings(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """``key, term, tf``: one row per term of a passage (O-AGG-9)."""
    return docs.select(key, F.explode(text.terms(F.col(body))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def corpus_stats(posted: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row ``n, avg_len``."""
    lengths = posted.agg(F.sum("tf").alias("total"))
    return docs.agg(F.count("*").alias("n")).join(lengths).select("n", (F.coalesce("total", F.lit(0)) / F.greatest(F.lit(1), "n")).alias("avg_len"))


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.05), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def term_stats(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """``term, df, idf`` (O-AGG-10)."""
    counts = posted.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))  # one row
    return counts.join(F.broadcast(n)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def question_terms(questions: DataFrame, key: str = "item_id", body: str = "text", split: Callable[[Column], Column] = text.terms) -> DataFrame:
    """Distinct terms of each question."""
    return questions.select(F.col(key).alias("question"), F.explode(F.array_distinct(split(F.col(body)))).alias("term"))


def bm25(questions: DataFrame, docs: DataFrame, key: str = "doc_id", question_key: str = "item_id", split: Callable[[Column], Column] = text.terms) -> DataFrame:
    """``question, key, lexical``: saturated BM25 of every passage that shares a term with a question (O-AGG-11, O-JOIN-6).

    ``split`` makes terms of a text: plain words, or stems by ``text.tokenize``.
    """
    asked = question_terms(questions, question_key, split=split)
    # Lengths stand in the row that the terms come from, and only asked terms leave the tokenising stage.
    worded = docs.select(key, split(F.col("text")).alias("terms"))
    stats = worded.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("total"))  # one row
    spread = worded.select(key, F.size("terms").alias("len"), F.explode("terms").alias("term"))
    posted = spread.join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    frequency = posted.groupBy("term").agg(F.count("*").alias("df"))
    met = asked.join(posted, "term").join(frequency, "term").join(F.broadcast(stats))
    norm = 1 - B + B * (F.col("len") / F.greatest(F.lit(1.0), F.col("total") / F.col("n")))
    weight = F.coalesce(idf(F.col("df"), F.col("n")), F.lit(UNSEEN_IDF))
    raw = F.sum(weight * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * norm))
    return met.groupBy("question", key).agg(raw.alias("raw")).select("question", key, F.round(F.col("raw") / (F.col("raw") + SATURATION), 9).alias("lexical"))


def ranked(scored: DataFrame, k: int = TOP_K, by: str = "question", key: str = "doc_id") -> DataFrame:
    """The first ``k`` of each question above the floor; ties by key (O-SRT-1, O-SRT-7, O-FLT-8)."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scored.where(F.col("score") > FLOOR).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def diversified(scored: DataFrame, group: str, k: int = TOP_K, by: str = "question", key: str = "doc_id") -> DataFrame:
    """Top k of which a group fills three quarters at most while others have something to say (O-WIN-1)."""
    most = max(1, math.ceil(SHARE * k))
    own = F.row_number().over(Window.partitionBy(by, group).orderBy(F.desc("score"), key))
    order = Window.partitionBy(by).orderBy("late", F.desc("score"), key)
    marked = scored.where(F.col("score") > FLOOR).withColumn("place", own).where(F.col("place") <= k)  # no later one can be among the first k
    return marked.withColumn("late", (F.col("place") > most).cast("int")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch: the ids and the vectors at unit length, as bytes."""
    for batch in batches:
        rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i is not None and v and any(v)]
        if rows:
            matrix = np.array([v for _, v in rows], np.float64)
            matrix /= np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            ids = np.array([i for i, _ in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "matrix"])


def _nearest(floor: float, limit: int):
    """(question, key, cosine) of the nearest vectors of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v_ids, v, q_ids, q in zip(*[batch.column(c).to_pylist() for c in ("ids", "matrix", "q_ids", "q_matrix")]):
                keys, asked = np.frombuffer(v_ids, np.int64), np.frombuffer(q_ids, np.int64)
                cosine = np.frombuffer(q, np.float64).reshape(len(asked), -1) @ np.frombuffer(v, np.float64).reshape(len(keys), -1).T
                for i, row in zip(asked.tolist(), cosine):
                    near = np.flatnonzero(row >= floor)
                    near = near[np.lexsort((keys[near], -np.round(row[near], 9)))[:limit]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), i)), pa.array(keys[near]), pa.array(row[near])], names=["question", "key", "cosine"])

    return run


def dense(questions: DataFrame, vectors: DataFrame, floor: float = DENSE_FLOOR, limit: int = DENSE_LIMIT, key: str = "vec_id") -> DataFrame:
    """``question, key, cosine``: for a stated set of questions (question, q), its nearest vectors (O-FLT-9).

    Norms are worked out once per vector. Blocks of questions meet blocks of vectors, one matrix product each, and what leaves a
    pair of blocks is ``limit`` rows per question at most. Rows without a vector, or with one of zeros only, are near nothing.
    """
    pack = "ids binary, matrix binary"
    ours = questions.select(F.col("question").cast("long"), "q").mapInArrow(_packed, pack).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    met = vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(_packed, pack).crossJoin(ours)  # of blocks
    close = met.mapInArrow(_nearest(floor, limit), "question long, key long, cosine double").withColumnRenamed("key", key)
    order = Window.partitionBy("question").orderBy(F.desc(F.round("cosine", 9)), key)
    return close.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def blended(lexical: DataFrame, near: DataFrame, embedded: DataFrame, key: str = "doc_id") -> DataFrame:
    """``question, key, score``: dense and lexical scores where the passage has a vector, else the lexical one alone (O-MTH-3)."""
    both = lexical.join(near.select("question", key, "cosine"), ["question", key], "full").join(embedded.select(key, F.lit(True).alias("has")), key, "left")
    lex = F.coalesce("lexical", F.lit(0.0))
    cos = values.rescaled(F.coalesce("cosine", F.lit(0.0)))
    score = F.when(F.coalesce("has", F.lit(False)), DENSE_WEIGHT * cos + LEXICAL_WEIGHT * lex).otherwise(lex)
    return both.select("question", key, F.round(score, 9).alias("score"))


def penalised(scored: DataFrame, owners: DataFrame, active: Column, key: str = "doc_id") -> DataFrame:
    """Passages that another plan owns count less (O-JOIN-8); of several owners of one the first by name counts. Without an active plan nothing changes."""
    met = scored.join(owners.where(F.col("owner").isNotNull()).groupBy(key).agg(F.min("owner").alias("owner")), key, "left")
    return met.withColumn("score", F.when(F.col("owner").isNotNull() & (F.col("owner") != active), F.round(F.col("score") * FOREIGN_PLAN, 9)).otherwise(F.col("score")))


def terms_held(hits: DataFrame, docs: DataFrame, key: str = "doc_id", split: Callable[[Column], Column] = text.terms) -> DataFrame:
    """``key, term`` of the passages among the first three of a question, from their texts."""
    seen = docs.join(hits.where("rank <= 3").select(key).distinct(), key, "left_semi")  # before the texts are split
    return seen.select(key, F.explode(F.array_distinct(split(F.col("text")))).alias("term"))


def confidence(hits: DataFrame, questions: DataFrame, held: DataFrame, key: str = "doc_id", question_key: str = "item_id", split: Callable[[Column], Column] = text.terms) -> DataFrame:
    """``question, top, coverage, confidence`` from the ranked hits and the terms (key, term) of their passages (O-AGG-12, O-MTH-4)."""
    asked = question_terms(questions, question_key, split=split)
    first = hits.where("rank <= 3").select("question", key)
    covered = asked.join(first, "question").join(held, [key, "term"], "left_semi").groupBy("question").agg(F.countDistinct("term").alias("covered"))
    wanted = asked.groupBy("question").agg(F.count("*").alias("wanted"))
    top = hits.where("rank = 1").select("question", F.col("score").alias("top"))
    met = questions.select(F.col(question_key).alias("question")).join(top, "question", "left").join(wanted, "question", "left").join(covered, "question", "left")
    coverage = F.coalesce("covered", F.lit(0)) / F.col("wanted")
    value = F.when(F.col("top").isNull(), 0.0).when(F.col("wanted").isNull(), F.least(F.lit(1.0), "top")).otherwise(F.least(F.lit(1.0), 0.7 * F.col("top") + 0.3 * coverage))
    return met.select("question", F.round("top", 6).alias("top"), F.round(coverage, 6).alias("coverage"), F.round(value, 6).alias("confidence"))
