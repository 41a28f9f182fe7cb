"""An approximate index over vectors: coarse cells, quantised residuals, probing, exact ranks (O-FLT-9).

Vectors are brought to unit length and go to the nearest of ``cells`` centroids, which are fitted on a sample of at most ``SAMPLE``
vectors (the bound does not grow with the table; every vector is indexed). A block is a row of up to ``BLOCK`` vectors of a cell: ids and the
residuals from the centroid as one byte per component, so that a large cell is many rows and no group is larger than a block. A question looks at
the blocks of its ``probes`` nearest cells: questions that probe the same cell travel together, one matrix product scores a block for
all of them, and what leaves it is at most ``keep`` ids for each question. The best ``keep`` of a question are then ranked by their exact cosines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values
from ..session import kept

SAMPLE, BLOCK, ROUNDS, SEED = 20_000, 1024, 8, 7
Batches = Iterator[pa.RecordBatch]


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows at unit length, for vectors that all have ``dim`` components and are not zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means centroids of the sample."""
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        owner = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-9), centroids)
    return centroids


def coded(centroids: np.ndarray, scale: float) -> Callable[[Batches], Batches]:
    """(cell, ids, codes) blocks of (id, vector)."""

    def run(batches: Batches) -> Batches:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(cell: int) -> pa.RecordBatch:
            ids, codes = (np.concatenate(x) for x in zip(*held.pop(cell)))
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=["cell", "ids", "codes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = unit(batch.column(1), centroids.shape[1]), batch.column(0).to_numpy()
            owner = (x @ centroids.T).argmax(axis=1)
            codes = np.clip(np.rint((x - centroids[owner]) / scale), -127, 127).astype(np.int8)
            for cell in np.unique(owner).tolist():
                mine = np.flatnonzero(owner == cell)
                for a in range(0, len(mine), BLOCK):
                    held.setdefault(cell, []).append((ids[mine[a : a + BLOCK]], codes[mine[a : a + BLOCK]]))
                    if sum(len(i) for i, _ in held[cell]) >= BLOCK:
                        yield block(cell)
        for cell in list(held):
            yield block(cell)

    return run


def probing(centroids: np.ndarray, probes: int) -> Callable[[Batches], Batches]:
    """(cell, question, q) for the nearest cells of each question."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = unit(batch.column(1), centroids.shape[1])
            near = np.argsort(-(q @ centroids.T), axis=1)[:, :probes]
            rows = np.repeat(np.arange(len(q)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(rows)), pa.array([q[i].tobytes() for i in rows], pa.binary())], names=["cell", "question", "q"])

    return run


def scanned(centroids: np.ndarray, scale: float, keep: int) -> Callable[[Batches], Batches]:
    """(question, key, near) of joined (cell, ids, codes, questions, qs): the nearest of a block for each question that probes it."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for cell, ids, codes, asked, qs in zip(*[batch.column(c).to_pylist() for c in ("cell", "ids", "codes", "questions", "qs")]):
                ids, q = np.frombuffer(ids, np.int64), np.frombuffer(b"".join(qs), np.float32).reshape(len(asked), -1)
                x = np.frombuffer(codes, np.int8).reshape(len(ids), -1).astype(np.float32) * scale + centroids[cell]
                near = q @ x.T
                some = min(keep, len(ids))
                best = np.argpartition(-near, some - 1, axis=1)[:, :some]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, some), pa.int64()), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(near, best, 1).ravel())], names=["question", "key", "near"])

    return run


@dataclass
class VectorIndex:
    """Blocks of a table of vectors; ``build`` makes one."""

    spark: SparkSession
    vectors: DataFrame
    blocks: DataFrame
    centroids: np.ndarray
    scale: float
    key: str

    @classmethod
    def build(cls, vectors: DataFrame, cells: int = 64, key: str = "vec_id", column: str = "embedding") -> VectorIndex:
        """Rows with a null id, or a vector that is null, zero, of another length than most or not finite, are in no block."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<float>").alias("v")).where("key is not null and v is not null")
        most = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
        dim = most.n if most else 1
        fits = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
        rows = rows.where((F.size("v") == dim) & fits)
        sample = [r.v for r in rows.orderBy(F.xxhash64("key")).select("v").limit(SAMPLE).collect()]
        if not sample:
            return cls(spark, rows, spark.createDataFrame([], "cell int, ids binary, codes binary"), np.zeros((1, dim), np.float32), 1.0, key)
        x = unit(pa.array(sample, pa.list_(pa.float32())), dim)
        centroids = fitted(x, cells)
        residuals = x - centroids[(x @ centroids.T).argmax(axis=1)]
        scale = float(max(np.abs(residuals).max(), 1e-6)) / 127
        blocks = rows.mapInArrow(coded(centroids, scale), "cell int, ids binary, codes binary")
        return cls(spark, rows, kept(blocks, "vector-blocks"), centroids, scale, key)

    def topk(self, questions: DataFrame, k: int = 10, probes: int = 48, keep: int | None = None) -> DataFrame:
        """``question, key, cosine, rank`` for questions (question, q); their vectors must fit the index."""
        keep = keep or 4 * k
        dim = self.centroids.shape[1]
        asked = questions.select(F.col("question").cast("long").alias("question"), F.col("q").cast("array<float>").alias("q")).where((F.size("q") == dim) & F.exists("q", lambda x: x != 0))
        together = asked.mapInArrow(probing(self.centroids, probes), "cell int, question long, q binary")
        # So many questions to a row: a cell that all questions probe is many rows.
        crowd = together.groupBy("cell", F.pmod(F.xxhash64("question"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("question", "q")).alias("a"))
        met = self.blocks.join(crowd.select("cell", F.col("a.question").alias("questions"), F.col("a.q").alias("qs")), "cell")
        near = met.mapInArrow(scanned(self.centroids, self.scale, keep), "question long, key long, near float")
        place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("near"), "key"))
        few = near.withColumn("place", place).where(F.col("place") <= keep).select("question", "key")
        pairs = few.join(self.vectors, "key").join(asked, "question").select("question", "key", values.cosine(F.col("v"), F.col("q")).alias("cosine"))
        rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.round("cosine", 9)), "key"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("key", self.key)
