"""A keyed Parquet table that a stream merges its batches into (O-STM-6, O-SNK-1, O-SNK-5).

Rows lie in ``BUCKETS`` buckets by the hash of their key. A batch is reduced to a row for each of its keys, joined with the buckets it touches
and with no others, and written as a new version of these. One commit row names the files of every bucket and the batch; readers go by
the newest, so they see a batch whole or not at all, and a batch that is run again after a failure is known by its number and
changes nothing. Files that neither of the last two versions names are removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_COMMITS = "batch long, files map<int, string>"


@dataclass
class UpsertTable:
    """``reduce`` makes a row of each key of a batch; ``merge`` gives each column from the (old, new) one, either of which may be null."""

    spark: SparkSession
    folder: str
    key: str
    reduce: Callable[[DataFrame], DataFrame]
    merge: dict[str, Callable[[Column, Column], Column]]
    schema: str
    buckets: int = BUCKETS

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.folder}/commits")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _COMMITS)

    def read(self) -> DataFrame:
        newest = self._commits().orderBy(F.desc("batch")).first()
        return self._files(list(newest.files.values()) if newest else [])

    def _files(self, names: list[str]) -> DataFrame:
        paths = [f"{self.folder}/data/{n}" for n in names]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merge a batch; call it from ``foreachBatch``."""
        last = self._commits().orderBy(F.desc("batch")).limit(2).collect()  # at most two rows of ``buckets`` names
        if last and number <= last[0].batch:
            return
        files = dict(last[0].files) if last else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = self.reduce(batch.where(F.col(self.key).isNotNull()))
        touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # at most ``buckets`` numbers
        old = self._files([files[b] for b in touched if b in files])
        met = old.alias("o").join(new.alias("n"), F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full")
        merged = met.select(F.coalesce(f"o.{self.key}", f"n.{self.key}").alias(self.key), *[f(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c, f in self.merge.items()])
        version = f"b{number:012d}-{uuid.uuid4().hex[:8]}"
        if touched:
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{version}")
        files |= {b: f"{version}/bucket={b}" for b in touched}
        self.spark.createDataFrame([(number, files)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        if len(last) == 2:  # the version before the last goes
            self._remove(set(last[1].files.values()) - set(last[0].files.values()) - set(files.values()))

    def _remove(self, names: set[str]) -> None:
        remote = re.match("[A-Za-z][A-Za-z0-9+.-]+:/", self.folder)
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder) if remote else (pyarrow.fs.LocalFileSystem(), self.folder)
        for name in names:
            if fs.get_file_info(f"{root}/data/{name}").type == pyarrow.fs.FileType.Directory:
                fs.delete_dir(f"{root}/data/{name}")

    def stream(self, source: DataFrame, checkpoint: str):
        """Merge all there is of a stream; ``awaitTermination`` of the query tells when it is done."""
        return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.apply).trigger(availableNow=True).start()


def sightings(spark: SparkSession, folder: str) -> UpsertTable:
    """Count, first and last sight of each user."""
    reduce = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    none = lambda c: F.coalesce(c, F.lit(0))
    merge = {"n": lambda o, n: none(o) + none(n), "first_at": lambda o, n: F.least(o, n), "last_at": lambda o, n: F.greatest(o, n)}
    return UpsertTable(spark, folder, "user_id", reduce, merge, "user_id long, n long, first_at timestamp, last_at timestamp")
