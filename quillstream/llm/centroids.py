"""Centroid clustering by delta Lloyd rounds over whole numbers (operator 12).

Vectors are turned into integers once. Each carries its owner and its distance to it from round to round in a written table, so a
round compares a vector with those centroids alone that the last round changed; where its own centroid changed, with all.
Vectors that go over to another centroid are the round's transfers: plus one vector for the new owner, minus one for the old.
Tasks add their transfers up before they send them, k rows of whole numbers for each task, and the sums and counts of all rounds
before are corrected by them and never counted anew. Whole numbers make the result exact: no order of rows or tasks changes it.

The driver holds k centroids and k sums of ``DIM`` numbers, whatever the number of vectors. There is no shuffle by vector or owner,
so neither equal vectors nor a large cluster make a hot key.

Defined cases: rows whose vector is null, has another number of components, or has a null, NaN or infinite one are left out;
components beyond 2^18 in size count as 2^18, so that squared distances fit a long; sums of distances beyond a long count
as the largest long; equal vectors share a cluster; a repeated vec_id is a vector each time; a null vec_id takes part, and can start a
centroid only after all others; with fewer vectors than centroids there are fewer centroids; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, release, table

DIM, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
MOST = 2**26  # of an integer component: 64 x (2 x 2^26)^2 = 2^60
EXACT = 2**22  # up to here a float64 holds every term and sum of a squared distance
Batches = Iterator[pa.RecordBatch]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of little-endian 32-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1)


def quantised(dim: int, scale: int) -> Callable[[Batches], Batches]:
    """(vec_id, q, owner, distance) of the vectors that take part; nobody owns them yet."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            vectors = batch.column(1)
            whole = batch.filter(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(vectors), dim), False))
            values = whole.column(1).flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            good = np.isfinite(x).all(axis=1)
            q = np.clip(np.floor(x[good] * scale), -MOST, MOST).astype("<i4")
            ids, n = whole.column(0).filter(pa.array(good)), len(q)
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in q], pa.binary()), pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int64))], names=["vec_id", "q", "owner", "distance"])

    return run


def first_by_hash(k: int, seed: int) -> Callable[[Batches], Batches]:
    """(no_id, hash, q): the task's ``k`` first vectors by the hash of their id."""

    def run(batches: Batches) -> Batches:
        best: list[tuple[bool, str, bytes]] = []
        for batch in batches:
            mine = ((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", q) for i, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            best = heapq.nsmallest(k, [*best, *mine])
        yield pa.RecordBatch.from_arrays([pa.array([b[j] for b in best], t) for j, t in enumerate((pa.bool_(), pa.string(), pa.binary()))], names=["no_id", "hash", "q"])

    return run


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids, as int64."""
    small = max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT
    a, b = q.astype(np.float64 if small else np.int64), centroids.astype(np.float64 if small else np.int64)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def assigned(centroids: np.ndarray, changed: np.ndarray) -> Callable[[Batches], Batches]:
    """(vec_id, q, owner, distance, before): the nearest centroid now, and the owner before; ties go to the smaller number."""
    movers = np.flatnonzero(changed)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, before = matrix(batch.column(1)), batch.column(2).to_numpy()
            owner, distance = before.copy(), batch.column(3).to_numpy().copy()
            anew = (before < 0) | changed[before]
            rows = np.flatnonzero(anew)
            if len(rows):
                d = distances(q[rows], centroids)
                owner[rows] = d.argmin(axis=1)
                distance[rows] = d[np.arange(len(rows)), owner[rows]]
            rows = np.flatnonzero(~anew)
            if len(rows) and len(movers):
                d = distances(q[rows], centroids[movers])
                near = d.argmin(axis=1)
                d, near = d[np.arange(len(rows)), near], movers[near]
                better = (d < distance[rows]) | ((d == distance[rows]) & (near < owner[rows]))
                owner[rows[better]], distance[rows[better]] = near[better], d[better]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(before)], names=["vec_id", "q", "owner", "distance", "before"])

    return run


def transfers(k: int, dim: int) -> Callable[[Batches], Batches]:
    """(cluster, delta): what the task's moved vectors add to each cluster, components and then the count."""

    def run(batches: Batches) -> Batches:
        delta = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.hstack([matrix(batch.column(0)).astype(np.int64), np.ones((batch.num_rows, 1), np.int64)])
            for owners, sign in ((batch.column(1).to_numpy(), 1), (batch.column(2).to_numpy(), -1)):
                for c in np.unique(owners[owners >= 0]):
                    delta[c] += sign * q[owners == c].sum(axis=0)
        touched = np.flatnonzero(delta.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(touched.astype(np.int32)), pa.array(list(delta[touched]), pa.list_(pa.int64()))], names=["cluster", "delta"])

    return run


_STATE = "vec_id long, q binary, owner int, distance long"


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, q, owner, distance`` after ``rounds`` rounds and a last assignment, and the centroids, for vectors (vec_id, embedding)."""
    state = durable(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(quantised(dim, scale), _STATE), "vectors")
    starts = state.select("vec_id", "q").mapInArrow(first_by_hash(k, seed), "no_id boolean, hash string, q binary")
    centroids = np.array([np.frombuffer(r.q, "<i4") for r in starts.orderBy("no_id", "hash", "q").limit(k).collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        return state, centroids
    k = len(centroids)
    sums, changed = np.zeros((k, dim + 1), np.int64), np.ones(k, bool)
    for turn in range(rounds + 1):
        last, state = state, durable(state.drop("before").mapInArrow(assigned(centroids, changed), f"{_STATE}, before int"), "assigned")
        release(last)
        if turn == rounds:
            break
        moved = state.where("owner <> before").select("q", "owner", "before").mapInArrow(transfers(k, dim), "cluster int, delta array<long>")
        for r in moved.select("cluster", F.posexplode("delta").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x")).collect():  # at most k times (dim + 1) numbers
            sums[r.cluster, r.place] += r.x
        held = sums[:, -1:] > 0
        new = np.where(held, sums[:, :-1] // np.maximum(sums[:, -1:], 1), centroids)
        changed = (new != centroids).any(axis=1)
        centroids = new
    return state, centroids


def described(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of each vector, with the inertia of its cluster and of all, and the digest of its centroid."""
    spark = state.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    fits = lambda x: F.least(x, F.lit(2**63 - 1)).cast("long")
    sums = state.groupBy("owner").agg(exact.alias("inertia"))  # k rows
    sums = sums.select("owner", "inertia", F.lit(1).alias("_one")).join(sums.agg(F.sum("inertia").alias("whole")))
    about = sums.join(spark.createDataFrame(digests, "owner int, centroid_sha256 string"), "owner").select("owner", fits(F.col("inertia")).alias("cluster_inertia"), fits(F.col("whole")).alias("inertia"), "centroid_sha256")
    return state.join(F.broadcast(about), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` that takes part, with its cluster after five rounds."""
    return described(*lloyd(table(spark, sf_dir, "embeddings")))


def sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> str:
    """The same clusters in DuckDB, every round counted anew."""
    steps = [
        f"v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q, row_number() over () as r from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: isfinite(x))) = {dim})",
        f"c0 as (select (row_number() over (order by sha256('{seed}:' || vec_id)) - 1)::int as c, q as m from v order by sha256('{seed}:' || vec_id) limit {k})",
    ]
    for i in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(v.q, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        steps.append(f"a{i} as materialized (select r, any_value(vec_id) as vec_id, any_value(q) as q, min(d) as d, arg_min(c, (d, c)) as c from (select r, vec_id, q, c, {gap}::bigint as d from v cross join c{i}) group by r)")
        if i < rounds:
            steps.append(f"s{i} as (select c, place, sum(x) as s, count(*) as n from (select c, unnest(q) as x, unnest(range({dim})) as place from a{i}) group by c, place)")
            steps.append(f"m{i} as (select c, list((s // n - case when s < 0 and s % n <> 0 then 1 else 0 end)::bigint order by place) as m from s{i} group by c)")
            steps.append(f"c{i + 1} as materialized (select c, coalesce(m{i}.m, c{i}.m) as m from c{i} left join m{i} using (c))")
    return f"""with {", ".join(steps)}
 select vec_id, c as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (c)"""
