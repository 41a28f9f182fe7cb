"""A session with the settings that all queries expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quillstream", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=fixed | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none: a temporary one in local mode, one in the warehouse on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    app = spark.sparkContext.applicationId
    if app not in _own:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        _own[app] = tempfile.mkdtemp(prefix="quillstream-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_quillstream-{app}"
    return _own[app]


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several plans read is worked out once, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
