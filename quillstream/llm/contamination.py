"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly (operator 5).

Test items and documents are sets of five-word shingles. The sketch of an item is its bottom-k MinHash: the k of its
shingles with the least hashes, k being set by the item's size. An item of n shingles that a document holds at
``THRESHOLD`` misses at most m = floor((1 - THRESHOLD) n) of them, so ``k = m + SPARE`` makes sure that SPARE of the sketch (all but
m, where the item is smaller) stand in the document: short items are sketched whole, long ones by a fifth, and no
document that holds an item is lost, however long it is. Documents that meet so much of a sketch are candidates, and
for these pairs alone the shared shingles are counted exactly. A bitmap, which never misses a shingle of an item, lets only
these leave the tasks.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters in lower case; items of fewer
than five words have no shingle and match nothing; null and empty texts match nothing; long texts are read whole;
repeated items each count, as do rows of one doc_id whose texts differ (equal ones count once); rows with a null
doc_id are told apart by their texts; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .wordhash import Words, bitmap_of, pieces, seeded, signed

SHINGLE, THRESHOLD, SPARE = 5, 0.8, 4


def sketch_size(n: int, threshold: float) -> tuple[int, int]:
    """Shingles in the sketch of an item of ``n``, and how many of them a document that holds the item has at least."""
    misses = int((1 - threshold) * n + 1e-9)
    k = min(n, misses + SPARE)
    return k, k - misses


def _items(threshold: float):
    """(item_id, n_item, need, shingles) of each test item, in the order of the MinHash: the first ``need`` + misses are its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sketched(batch, threshold)

    return run


def _sketched(batch: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in pieces(batch):
        words = Words(data, offsets)
        hashes, at = words.shingles(SHINGLE)
        ends = np.searchsorted(words.doc[at], np.arange(part.num_rows + 1))
        shingles = [np.unique(hashes[a:b]) for a, b in zip(ends, ends[1:])]
        shingles = [x[np.argsort(seeded(x, 3))] for x in shingles]
        sizes = [sketch_size(len(x), threshold) for x in shingles]
        columns = [part.column(0), pa.array([len(x) for x in shingles], pa.int64()), pa.array([k for k, _ in sizes], pa.int64()), pa.array([need for _, need in sizes], pa.int64()), pa.array([signed(x) for x in shingles], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "n_item", "k", "need", "shingles"])


def _scan(shingle_map):
    """(doc_id, text_hash, key): the item shingles in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                words = Words(data, offsets)
                hashes, at = words.shingles(SHINGLE)
                hit = np.flatnonzero(shingle_map.value.has(hashes))
                doc, keys = words.doc[at[hit]], hashes[hit]
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]) if len(doc) else np.zeros(0, bool)
                rows = pa.array(doc[fresh])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(signed(keys[fresh]))], names=["doc_id", "text_hash", "key"])

    return run


def _held(docs: DataFrame, items: DataFrame, threshold: float, text: str, doc_id: str, item_id: str, item_text: str) -> DataFrame:
    """``doc_id, text_hash, item_id, n_shared, n_item``."""
    spark = docs.sparkSession
    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.lower(F.col(item_text)).alias("text"))
    known = durable(named.mapInArrow(_items(threshold), "item_id long, n_item long, k long, need long, shingles array<long>").where("n_item > 0").withColumn("item", F.xxhash64("item_id", "shingles")).dropDuplicates(["item"]), "items")
    shingle_map = spark.sparkContext.broadcast(bitmap_of(known.select(F.explode("shingles").alias("h")), "h"))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.lower(F.col(text)).alias("text"))
    found = durable(slim.mapInArrow(_scan(shingle_map), "doc_id long, text_hash long, key long").withColumn("doc", F.xxhash64("doc_id", "text_hash")), "item-hits")
    sketches = known.select("item", "need", F.explode(F.slice("shingles", F.lit(1), F.col("k").cast("int"))).alias("key"))
    met = found.select("doc", "key").distinct().join(sketches, "key").groupBy("doc", "item").agg(F.count("*").alias("met"), F.first("need").alias("need"))
    candidates = durable(met.where("met >= need").select("doc", "item"), "item-candidates")
    asked = found.select("doc", "doc_id", "text_hash", "key").distinct().join(candidates, "doc")
    shared = asked.join(known.select("item", "item_id", "n_item", F.explode("shingles").alias("key")), ["item", "key"])
    return shared.groupBy("doc_id", "text_hash", "item", "item_id", "n_item").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") / F.col("n_item") >= threshold)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` for every item that a document holds."""
    held = _held(docs, items, threshold, text, doc_id, item_id, item_text)
    return held.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns kept."""
    held = _held(docs, items, THRESHOLD, "text", "doc_id", "item_id", "text").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h"))
    return docs.join(held, same, "left_anti").select(*docs.columns)


def op5_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
