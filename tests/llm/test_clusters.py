"""Delta Lloyd against SQL and against plain Lloyd rounds."""

import hashlib

import duckdb
import numpy as np
import pytest

from quillstream.llm import centroids

FOLDER = "/root/testdata/sf0.001"


def plain(rows, k, rounds, seed=2):
    """(vec_id, cluster, distance) by full comparisons over Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [max(-(2**26), min(2**26, int(np.floor(x * 256)))) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))
    cents = [v for _, v in first[:k]]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(cents)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept]


def test_op12_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    got = centroids.op12_delta_lloyd(spark, FOLDER)
    cursor = duck.execute(centroids.sql())
    assert got.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("scale", [0.3, 3e5])
def test_op12_odd_rows_and_large_numbers(spark, tmp_path, scale):
    """Ties, equal vectors, a third of all rows the same vector, ids that are null or repeat, rows that take no part; numbers beyond a float's exactness."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * scale).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, [0.25] * 64) for i in range(60)] + [(None, [0.5] * 64), (5, [0.125] * 64), (900, [1e30] * 64), (901, [-1e30] * 64)]
    rows += [(300, None), (301, [1.0] * 63), (302, [float("nan")] * 64), (303, [float("inf")] + [0.0] * 63), (304, [None] + [0.0] * 63), (305, [])]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, owner int, distance string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    state, _ = centroids.lloyd(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), k=7)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r) for r in state.select("vec_id", "owner", "distance").collect()), key=key) == sorted(plain([(i, v) for i, v in rows], 7, 5), key=key)
    assert centroids.op12_delta_lloyd(spark, str(tmp_path)).where("cluster_inertia > inertia or distance > cluster_inertia").count() == 0


def test_op12_unchanged_centroids_are_not_compared():
    """Only changed centroids are compared with vectors whose own centroid stayed."""
    import pyarrow as pa

    q = [np.full(64, x, "<i4").tobytes() for x in (0, 10, 20)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(q), pa.array([0, 0, 1], pa.int32()), pa.array([0, 6400, 0])], names=["vec_id", "q", "owner", "distance"])
    cents = np.array([[0] * 64, [20] * 64, [10] * 64, [5] * 64])
    out = next(centroids.assigned(cents, np.array([False, False, True, False]))(iter([batch])))
    assert out.column("owner").to_pylist() == [0, 2, 1] and out.column("distance").to_pylist() == [0, 0, 0]


def test_op12_few_and_none(spark, tmp_path):
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.75] * 64)], "vec_id long, embedding array<float>")
    state, cents = centroids.lloyd(few)
    assert len(cents) == 2 and {r.distance for r in state.collect()} == {0}
    few.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.op12_delta_lloyd(spark, str(tmp_path)).collect() == []
