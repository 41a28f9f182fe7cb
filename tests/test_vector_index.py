"""Recall of the vector index against exact cosines, hot cells, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.operators import search
from quillstream.operators.vector_index import VectorIndex


def recall(vectors, questions, k=10, **options):
    exact = search.dense(questions, vectors, floor=-1.0, limit=k).select("question", "vec_id", F.round("cosine", 6).alias("c")).collect()
    found = VectorIndex.build(vectors).topk(questions, k, **options).collect()
    least = {}
    for r in exact:
        least[r.question] = min(least.get(r.question, 9.0), r.c)
    hits = sum(round(r.cosine, 6) >= least[r.question] - 2e-6 for r in found)  # equal vectors stand for one another
    assert all(abs(dict(((e.question, e.vec_id), e.c) for e in exact).get((r.question, r.vec_id), r.cosine) - r.cosine) < 2e-6 for r in found)
    return hits / len(exact)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, scale):
    vectors = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("q"))
    assert recall(vectors, asked) >= 0.9


def test_hot_cell_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(600)] + [(1000 + i, [1.0] * 8) for i in range(3000)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [1.0] * 7), (None, [1.0] * 8), (5003, [float("nan")] + [1.0] * 7), (5004, [None] + [1.0] * 7)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    good = vectors.where("vec_id < 5000")
    asked = good.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("q"))
    assert recall(good, asked) >= 0.9
    index = VectorIndex.build(vectors)
    sizes = [len(r.ids) // 8 for r in index.blocks.collect()]
    assert sum(sizes) == 3600 and max(sizes) <= 2048 and index.topk(asked).where("vec_id >= 5000").count() == 0
    none = VectorIndex.build(vectors.limit(0))
    assert none.topk(asked.limit(0)).count() == 0
