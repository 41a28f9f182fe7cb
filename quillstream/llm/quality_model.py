"""Quality classifier: a factorisation machine (operator 8).

A document becomes hashed words (presence, scaled to unit length over its distinct buckets) and structure
statistics of its characters, words and lines. The model has a weight and ``FACTORS`` latent factors for each
input; pairwise interactions cost linear time by the identity sum_{i<j} <v_i, v_j> x_i x_j =
(|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2. It is fitted by Adagrad on the logistic loss over at most
``MAX_TRAIN`` labelled rows, taken in the order of a hash of doc_id from rows whose crc32(doc_id) mod 3 is
not 1. Labels, lang, source and doc_id are never inputs. All documents are scored, whole.

Defined cases: null and empty texts get a score from the statistics alone; without labelled rows, or with one
label only, every score is the smoothed share of label 1; repeated rows are each scored; rows with a null
doc_id are scored and count as not held out; an empty table gives an empty result; clashing columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordhash import NOT_SPACE, U64, Words, pieces, seeded

BUCKETS, FACTORS = 1 << 16, 8
MAX_TRAIN, EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 6_000, 4, 600, 32, 0.05, 1e-5
STATS = 18


def _kinds() -> np.ndarray:
    """Class of each byte: 0 other, 1 upper, 2 lower, 3 digit, 4 sentence marks, 5 loud marks, 6 symbols, 7 bars, 8 line end, 9 space, 10 longer characters."""
    kinds = np.zeros(256, np.int64)
    for k, chars in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, b".,;:'\"()-"), (5, b"!?"), (6, b"#*$%&<>@^~=+_\\/{}[]"), (7, b"|"), (8, b"\n"), (9, b" \t\r\x0b\x0c"), (10, range(128, 256))):
        kinds[list(chars)] = k
    return kinds


_KIND = _kinds()





def inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of the distinct hashed words, and the statistics of each text."""
    n = len(offsets) - 1
    words = Words(data, offsets, NOT_SPACE)
    doc = words.doc
    keys = np.sort((doc.astype(U64) << U64(16)) | (seeded(words.hashes, 31) >> U64(48)))
    keys = keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]
    row, bucket = (keys >> U64(16)).astype(np.int64), (keys & U64(BUCKETS - 1)).astype(np.int64)

    size = np.maximum(np.diff(offsets), 1).astype(float)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(text_of * 11 + _KIND[data], minlength=n * 11).reshape(n, 11)
    n_words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / some - mean**2, 0))
    again = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1]))
    repeats = np.bincount(doc[again], minlength=n) / some
    distinct = np.bincount(row, minlength=n) / some
    lines = shares[:, 8] + 1.0
    stats = np.column_stack([shares / size[:, None], np.log1p(n_words), mean, spread, repeats, distinct, np.log(n_words / lines + 1), np.log(lines)])
    return row, bucket, stats


@dataclass
class Machine:
    """A fitted model; ``weights`` and ``factors`` have the hashed words first, then the statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def lay_out(self, row: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted row numbers, inputs and their values of all texts."""
        n = len(stats)
        value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
        scaled = np.clip((stats - self.mean) / self.scale, -4, 4) * 0.25
        rows = np.concatenate([row, np.repeat(np.arange(n), STATS)])
        order = np.argsort(rows, kind="stable")
        return rows[order], np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + STATS), n)])[order], np.concatenate([value, scaled.reshape(-1)])[order]

    def margin(self, rows: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The raw score of each text and its sums of v_i x_i."""
        first = np.searchsorted(rows, np.arange(n))
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        linear = np.add.reduceat(self.weights[index] * value, first)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), first)), sums

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket, stats = inputs(data, offsets)
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.lay_out(row, bucket, stats), len(stats))[0], -30, 30)))


def fit(rows: list[np.ndarray], stats: np.ndarray, labels: np.ndarray) -> Machine:
    """``rows``: distinct buckets of each text."""
    rng = np.random.default_rng(8)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    mean = stats.mean(axis=0) if len(stats) else np.zeros(STATS)
    scale = (stats.std(axis=0) if len(stats) else np.ones(STATS)) + 1e-6
    model = Machine(bias, np.zeros(BUCKETS + STATS), rng.normal(0, 0.02, (BUCKETS + STATS, FACTORS)), mean, scale)
    if not len(labels) or labels.min() == labels.max():
        model.factors[:] = 0
        return model
    seen_w, seen_v, seen_b = np.full(BUCKETS + STATS, 1e-4), np.full((BUCKETS + STATS, FACTORS), 1e-4), 1e-4
    turns = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(labels)))
    for _ in range(turns):
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            n = len(part)
            r, index, value = model.lay_out(np.repeat(np.arange(n), [len(rows[i]) for i in part]), np.concatenate([rows[i] for i in part]).astype(np.int64), stats[part])
            raw, sums = model.margin(r, index, value, n)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / n
            touched, at = np.unique(index, return_inverse=True)
            per = slope[r] * value
            gw = np.bincount(at, per, len(touched)) + DECAY * model.weights[touched]
            gv_each = per[:, None] * (sums[r] - model.factors[index] * value[:, None])
            gv = np.column_stack([np.bincount(at, gv_each[:, k], len(touched)) for k in range(FACTORS)]) + DECAY * model.factors[touched]
            seen_w[touched] += gw**2
            seen_v[touched] += gv**2
            model.weights[touched] -= RATE * gw / np.sqrt(seen_w[touched])
            model.factors[touched] -= RATE * gv / np.sqrt(seen_v[touched])
            seen_b += float(slope.sum()) ** 2
            model.bias -= RATE * float(slope.sum()) / np.sqrt(seen_b)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            row, bucket, stats = inputs(data, offsets)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32())), pa.array(list(stats), pa.list_(pa.float64()))],
                names=["doc_id", "label", "buckets", "stats"],
            )


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, label: str = "quality") -> Machine:
    """Fit on at most ``most`` labelled rows; no held-out row is among them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")  # at most ``most`` rows
    rows = met.mapInArrow(_inputs, "doc_id long, label int, buckets array<int>, stats array<double>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    stats = np.array(rows.column("stats").to_pylist(), float).reshape(-1, STATS)
    flat = rows.column("buckets").combine_chunks()
    return fit([x.values.to_numpy() for x in flat] if len(flat) else [], stats, rows.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(data, offsets))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """The documents that the model accepts, all columns kept, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                yield part.filter(pa.array(shared.value.score(data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
