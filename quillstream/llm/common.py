"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word and line contracts name it.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's switch for removing the shuffle files of a write when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none: a temporary one in local mode, one in the warehouse on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        _own_dir[app] = tempfile.mkdtemp(prefix="quillstream-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_quillstream-{app}"
    return _own_dir[app]


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The shuffle files of the write, which nothing reads again, go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path  # for ``release``
    return out


def release(*tables: DataFrame) -> None:
    """Empty tables that ``durable`` wrote and that no plan will read again. Whatever is left goes with the shared folder."""
    for df in tables:
        none = df.sparkSession.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        none.write.mode("overwrite").parquet(df._written_to)


def numbered(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """``node, text`` of all rows, and ``node, doc_id, text_hash`` of them. Nodes are in the order of doc_id (null last) and text.

    Where no doc_id is null or repeated, a node is the doc_id and there is no second table. Rows equal in both share a node.
    """
    own = F.col(doc_id).cast("long")
    if docs.groupBy(own.alias("i")).count().where("count > 1 or i is null").isEmpty():
        return docs.select(own.alias("node"), F.col(text).alias("text")), None
    told = docs.select(own.alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    names = told.select("doc_id", "text_hash").distinct().orderBy(F.asc_nulls_last("doc_id"), "text_hash").withColumn("node", F.monotonically_increasing_id())
    names = durable(names, "names")
    other = names.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "node")
    return told.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("node", "text"), names


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def ascii_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
