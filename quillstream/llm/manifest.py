"""Merkle manifest of a dataset: a tree of digests for each group, a tree over the groups, proofs, and what a changed row does (operator 13).

A leaf is the SHA-256 of a row's fields, each with its length in front. Leaves of a group stand in the order of their key,
and a level of all trees at once is one window: nodes partitioned by group and parent index, and an ordered, full-frame
``collect_list`` that gives a node both its siblings and its parent's preimage. The first node of each run alone stands for the parent, so
a parent enters the next level once. Three levels share an exchange by the widest block and go to one table; the next has a row for 27
of its rows. The roots of the groups are the leaves of a last tree of the
same kind. Then the tables are joined from the top down, which gives each leaf its path: siblings to the left and to the right, one pair for
each level. With that path anyone can fold a leaf up to the root.

Places within a group come from one range partitioning by group and key, so a group of a third of all rows lies in as many tasks as
its size asks for; offsets are worked out over (task, group) alone. Digests travel as 32 bytes, texts never leave the task that
reads them. The driver learns two numbers, the most leaves of a group and the number of groups, to know the height of the trees.

Defined cases: a null field is ``-``; rows with a null key come first in their group, and rows with equal keys are ordered by their
leaf; repeated rows are leaves each; a null group is the first of the groups, an empty text is a field of no bytes, long texts are
hashed whole; the single leaf of a group is its root, the single group's root is the root; an empty table gives an empty result;
further columns are ignored. A row without a key is not tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import durable, release, table

FANOUT, STEPS = 3, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """Length in bytes, a colon and the value; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with a row number ``at`` along (group, order), and ``part, group, first, before, n`` of each task's share of a group.

    A row of the share is row ``before + at - first`` of its group's ``n``.
    """
    cut = durable(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()), "placed")
    shares = cut.groupBy(F.shiftright("at", 33).alias("part"), group).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    along = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return cut, durable(shares.select("part", group, "first", F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n")), "shares")


def _located(cut: DataFrame, shares: DataFrame, group: str) -> DataFrame:
    kept = [c for c in shares.columns if c not in ("part", group)]
    other = shares.select(F.col("part").alias("_part"), F.col(group).alias("_group"), *kept)
    met = cut.join(other, F.col(group).eqNullSafe(F.col("_group")) & (F.shiftright("at", 33) == F.col("_part"))).drop("_group", "_part")
    return met.withColumn("idx", F.col("before") + F.col("at") - F.col("first"))


def levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The trees from ``grp, n, idx, hash`` and other columns, ``STEPS`` levels to a table, and the roots ``grp, hash``.

    A table keeps the columns of its nodes and adds ``steps``, for each of its levels the number of siblings to the left, to the right and
    their digests (nothing where the tree has ended), and ``up``, the digest above its highest level, in the first row below it. All
    levels of a table share one exchange and one sort.
    """
    found: list[DataFrame] = []
    span = FANOUT**STEPS
    while most > 1:
        blocks = [f"_b{FANOUT ** (STEPS - i)}" for i in range(STEPS)]  # from the widest to the runs of the lowest level
        level = nodes.withColumns({b: F.floor(F.col("idx") / int(b[2:])) for b in blocks}).repartition("grp", blocks[0]).withColumn("up", F.col("hash"))
        steps = []
        for i in range(STEPS):
            width, depth = FANOUT**i, STEPS - i
            run = Window.partitionBy("grp", *blocks[:depth]).orderBy(*blocks[depth:], "idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            lone, spot = F.ceil(F.col("n") / width) == 1, (F.floor(F.col("idx") / width) % FANOUT).cast("int")
            level = level.withColumn(f"_kids{i}", F.collect_list(hexed(F.col("up"))).over(run))  # only the first row of a node's own run has its digest
            kids = F.col(f"_kids{i}")
            byte = lambda n: F.lpad(F.hex(n), 2, "0")
            siblings = F.concat(byte(spot), byte(F.size(kids) - 1 - spot), F.array_join(F.slice(kids, F.lit(1), spot), ""), F.array_join(F.slice(kids, spot + 2, F.lit(FANOUT)), ""))
            steps.append(F.when(lone, "").otherwise(siblings))
            above = F.when(lone, F.col("up")).otherwise(digest(F.array_join(kids, "")))
            level = level.withColumn("up", F.when(F.col("idx") % (width * FANOUT) == 0, above))
        found.append(durable(level.select(*nodes.columns, F.unhex(F.concat(*steps)).alias("steps"), "up"), "level"))
        nodes = found[-1].where(f"idx % {span} = 0").select("grp", F.ceil(F.col("n") / span).alias("n"), F.floor(F.col("idx") / span).alias("idx"), F.col("up").alias("hash"))
        most = -(-most // span)
    return found, nodes.select("grp", "hash")


def paths(found: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest level with ``path`` and the other columns of ``top`` (grp, path, ...), which has a row for each tree.

    Each table meets the one above it by group and parent index, a unique key; Spark broadcasts what its size allows.
    """
    others = [c for c in top.columns if c not in ("grp", "path")]
    above = top.withColumn("_up", F.lit(0).cast("long"))
    for i, level in reversed(list(enumerate(found))):
        plain = [c for c in level.columns if c not in ("steps", "up", "n", "grp", "idx")] if i == 0 else []
        met = level.withColumn("_up", F.floor(F.col("idx") / FANOUT**STEPS)).join(above, ["grp", "_up"])
        above = met.select("grp", F.col("idx").alias("_up"), F.concat("steps", "path").alias("path"), *others, *plain)
        if i:
            above = durable(above, "paths")
    return above.withColumnRenamed("_up", "idx")


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, hash, changed``: the leaf, and the leaf after tampering where that makes another one."""
    of = lambda text: digest(*[field(text if name == "text" else F.col(name)) for name in FIELDS])
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(even & F.contains("text", F.lit("\n")), of(F.replace("text", F.lit("\n"), F.lit(""))))
    return docs.select("doc_id", "source", of(F.col("text")).alias("hash"), changed.alias("changed"))


def manifest(rows: DataFrame, group: str = "source", key: str = "doc_id") -> DataFrame:
    """``key, hash, path, subroot, root`` and the other columns of each leaf row (key, group, hash, ...)."""
    kept = durable(rows, "leaves")
    cut, shares = placed(kept, group, [key, "hash"])
    names, spans = placed(shares.select(group).distinct().withColumn("_one", F.lit(0)), "_one", [group])
    groups = _located(names, spans, "_one").select(group, F.col("idx").alias("grp"), F.col("n").alias("groups"))
    groups = durable(groups, "groups")
    most, count = (groups.agg(F.max("groups")).first()[0] or 0), (shares.agg(F.max("n")).first()[0] or 0)
    known = groups.select(F.col(group).alias("_name"), "grp")
    shares = shares.join(known, F.col(group).eqNullSafe(F.col("_name"))).drop("_name")
    others = [c for c in rows.columns if c not in (group, "hash")]
    nodes = _located(cut, shares, group).select("grp", "n", "idx", "hash", *others, F.col("hash").alias("leaf"))
    low, roots = levels(nodes, count)
    if not low:  # no group has two leaves
        roots = durable(nodes, "level")
        low = [roots.withColumns({"steps": F.lit(b""), "up": F.col("hash")})]
    subroots = durable(roots.select("grp", F.col("hash").alias("subroot")), "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("grp"), F.lit(most).cast("long").alias("n"), F.col("grp").alias("idx"), F.col("subroot").alias("hash"), "subroot")
    high, root = levels(tops, most)
    root = root.select(F.col("hash").alias("root"))  # one row
    none = F.lit(b"")
    if high:
        upper = paths(high, root.select(F.lit(0).cast("long").alias("grp"), none.alias("path"), "root")).select(F.col("idx").alias("grp"), "path", "subroot", "root")
    else:
        upper = tops.select(F.col("idx").alias("grp"), none.alias("path"), "subroot", F.col("subroot").alias("root"))
    out = paths(low, durable(upper, "paths"))
    release(kept)
    return out.drop("grp", "idx", "hash")


def walked(path: bytes, leaf: bytes) -> tuple[str, str]:
    """SHA-256 over the siblings of a path, and the root that the leaf and they give."""
    at, seen, node = 0, hashlib.sha256(), leaf.hex()
    while at < len(path):
        middle = at + 2 + 32 * path[at]
        end = middle + 32 * path[at + 1]
        left, right = path[at + 2 : middle].hex(), path[middle:end].hex()
        seen.update((left + right).encode())
        node, at = hashlib.sha256((left + node + right).encode()).hexdigest(), end
    return seen.hexdigest(), node


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but the last two, then ``proof_sha256, folded_root`` of these two: a path and a leaf."""
    for batch in batches:
        both = [walked(*pair) for pair in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
        columns = [*batch.columns[:-2], pa.array([p for p, _ in both], pa.string()), pa.array([r for _, r in both], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "proof_sha256", "folded_root"])


def verified(proved: DataFrame, key: str = "doc_id", changed: str = "changed") -> DataFrame:
    """The rows of ``manifest`` with their proofs, and whether their leaves (``changed`` ones where there are any) still give the root."""
    rows = proved.select(key, *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], "path", F.coalesce(changed, "leaf").alias("now"))
    kept = rows.drop("path", "now").schema
    out = rows.mapInArrow(folded, StructType([*kept.fields, StructField("proof_sha256", StringType()), StructField("folded_root", StringType())]))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, roots, proof and the root that its text gives after tampering."""
    return verified(manifest(leaves(table(spark, sf_dir, "documents").select(*FIELDS))))
