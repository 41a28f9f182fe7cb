"""Minimax contiguous partition of a corpus into shards (operator 9, DataFrame functions only).

Rows with equal texts form an atomic group. Groups are ordered by the 64-bit hash of their text, and the
smallest capacity under which a greedy sweep needs no more than the given number of shards is found by
binary search. The sweep needs prefix sums only near the places where a cut can fall, so the driver first
holds at most 65,536 sums of hash ranges, then splits just the ranges that a cut may hit, 256 ways at a
time, until those are single groups: exact for any number of groups, with driver memory that does not
grow with the corpus.

Defined cases: a null text counts as empty; repeated rows and ties share a shard; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

FIRST_BITS, MORE_BITS = 16, 8
ROWS_PER_BUCKET, MOST_BUCKETS = 2_000, 4_096


class _Line:
    """Sizes of consecutive hash ranges; cuts fall between them only."""

    def __init__(self, parts: list[tuple[int, int, int, int]]):
        self.parts = sorted(parts)  # (first key of the range, bits, bytes, groups)
        self.ends = list(accumulate((p[2] for p in self.parts), initial=0))

    def reach(self, start: int, capacity: int) -> int:
        """How many parts fit whole from part ``start`` on."""
        return bisect_right(self.ends, self.ends[start] + capacity) - 1

    def fits(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.reach(at, capacity)
        return at == len(self.parts)

    def smallest(self, low: int, shards: int) -> int:
        high = self.ends[-1]
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards) else (middle + 1, high)
        return low

    def doubtful(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Runs of parts that a cut can hit under some capacity from ``low`` to ``high``, where these hold parts of several groups."""
        if low == high:
            return []
        runs: list[tuple[int, int]] = []
        at = 0
        for s in range(1, shards):
            at = self.reach(at, low)
            last = min(bisect_left(self.ends, min(self.ends[-1], s * high)) + 1, len(self.parts))
            if any(p[3] > 1 for p in self.parts[at:last]):
                runs = [*runs[:-1], (runs[-1][0], max(last, runs[-1][1]))] if runs and runs[-1][1] >= at else [*runs, (at, last)]
        return runs

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of shards: each as near to an equal share of what is left as ``capacity`` allows."""
        latest = [len(self.parts)]
        for _ in range(shards - 1):  # from the right: the first part from which the rest still fits
            latest.append(bisect_left(self.ends, self.ends[latest[-1]] - capacity))
        at, out = 0, []
        for left in range(shards, 0, -1):
            share = (self.ends[-1] - self.ends[at]) / left
            near = bisect_left(self.ends, self.ends[at] + share)
            if near > at and near < len(self.ends) and self.ends[near] - self.ends[at] - share > share - self.ends[near - 1] + self.ends[at]:
                near -= 1
            at = max(at, min(max(near, latest[left - 1]), self.reach(at, capacity)))
            out.append(at)
        return out


def _sums(groups: DataFrame, bits: int, ranges: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    if ranges is not None:
        condition = F.lit(False)
        for low, high in ranges:
            condition = condition | F.col("key").between(low, high)
        groups = groups.where(condition)
    shift = 64 - bits
    prefix = F.shiftright("key", shift) if shift else F.col("key")
    rows = groups.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups")).collect()
    return [(r.prefix << shift, bits, r.bytes, r.groups) for r in rows]


def boundaries(groups: DataFrame, shards: int) -> list[int]:
    """First keys of shards 1, 2, ...: ``groups`` has one row (key, bytes) per atomic group."""
    biggest = groups.agg(F.max("bytes")).first()[0]
    if biggest is None:
        return []
    line = _Line(_sums(groups, FIRST_BITS))
    low = max(biggest, -(-line.ends[-1] // shards))
    while True:
        capacity = line.smallest(low, shards)
        runs = line.doubtful(low, capacity, shards)
        if not runs:
            break
        split = [p for a, b in runs for p in line.parts[a:b]]
        ranges = [(line.parts[a][0], line.parts[b - 1][0] + (1 << (64 - line.parts[b - 1][1])) - 1) for a, b in runs]
        bits = min(64, min(p[1] for p in split if p[3] > 1) + MORE_BITS)
        gone = {p[0] for p in split}
        line = _Line([p for p in line.parts if p[0] not in gone] + _sums(groups, bits, ranges))
    ends = line.cuts(capacity, shards)
    return [line.parts[e][0] if e < len(line.parts) else (1 << 63) - 1 for e in ends[:-1]]


def _between(key: Column, firsts: list[int]) -> Column:
    shard = F.lit(0)
    for s, first in enumerate(firsts, 1):
        shard = F.when(key >= first, s).otherwise(shard)
    return shard.cast("int")


def minimax_shards(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = durable(
        docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole).alias("key")),
        "shard-rows",
    )
    groups = durable(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "shard-groups")
    firsts = boundaries(groups, shards)
    total = groups.agg(F.sum("copies")).first()[0] or 0
    buckets = min(MOST_BUCKETS, total // (shards * ROWS_PER_BUCKET) + 1)
    dealt = rows.withColumn("shard", _between(F.col("key"), firsts)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    # Slots are numbered within small buckets and offset by the counts of the buckets before: no shard has to meet in one task.
    counts = dealt.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key"))
    return (
        dealt.withColumn("inside", inside)
        .join(F.broadcast(offsets), ["shard", "bucket"])  # at most shards * MOST_BUCKETS rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("inside") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"), 24)
