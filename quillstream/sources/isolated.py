"""Several sources read side by side, each with its own failure; header rows searched in many sheets at once.

Operators: O-JOIN-16, O-SRC-13, O-SRC-20. A source that is missing, forbidden or damaged is a row of the report and an empty table; the others are
what they would be without it. Lines of text formats that do not fit the schema are kept beside the good rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

_CORRUPT, TOGETHER = "_corrupt", 4


@dataclass
class Source:
    """``wanted=False`` leaves it out, which is no failure."""

    name: str
    path: str
    schema: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    wanted: bool = True


@dataclass
class Gathered:
    """``tables`` and ``corrupt`` (one column of raw lines) by source, and ``report``: source, state (ok, partial, skipped, forbidden, failed), rows, corrupt, error."""

    tables: dict[str, DataFrame]
    corrupt: dict[str, DataFrame]
    report: DataFrame


def gather(spark: SparkSession, sources: list[Source]) -> Gathered:
    """Read sources as separate jobs, ``TOGETHER`` at a time. What a source gives is written once, so that a failure shows here and not in a later plan."""

    def take(source: Source) -> tuple[DataFrame, DataFrame, tuple]:
        empty, none = spark.createDataFrame([], source.schema), spark.createDataFrame([], f"{_CORRUPT} string")
        if not source.wanted:
            return empty, none, (source.name, "skipped", 0, 0, None)
        lined = source.format in ("csv", "json")
        try:
            reader = spark.read.format(source.format).options(**source.options).schema(f"{source.schema}, {_CORRUPT} string" if lined else source.schema)
            if lined:
                reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
            rows = kept(reader.load(source.path), f"source-{source.name}")
            good, bad = (rows.where(f"{_CORRUPT} is null").drop(_CORRUPT), rows.where(f"{_CORRUPT} is not null").select(_CORRUPT)) if lined else (rows, none)
            n, odd = good.count(), bad.count()
            return good, bad, (source.name, "partial" if odd else "ok", n, odd, None)
        except (PySparkException, Py4JJavaError) as e:  # the second: what Spark has no condition for, such as a damaged file
            denied = "AccessControlException" in str(e) or "Permission denied" in str(e)
            condition = e.getCondition() if isinstance(e, PySparkException) else None
            return empty, none, (source.name, "forbidden" if denied else "failed", 0, 0, condition or type(e).__name__)

    with ThreadPoolExecutor(TOGETHER) as pool:
        taken = list(pool.map(take, sources))
    report = spark.createDataFrame([t[2] for t in taken], "source string, state string, rows long, corrupt long, error string")
    names = [s.name for s in sources]
    return Gathered({n: t[0] for n, t in zip(names, taken)}, {n: t[1] for n, t in zip(names, taken)}, report)


def label_of(cell: Column) -> Column:
    """A header cell in lower case, runs of other characters than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(cell, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def header_rows(rows: DataFrame, labels: dict[str, list[str]], first: int = 10, least: int = 2) -> DataFrame:
    """``file, header, columns``: of each sheet the row among its ``first`` that holds the most of the labels, the earliest of equals, and position by field.

    rows: file, row_no, cells. Of two cells with one field's labels the left one counts. Sheets where no row has ``least`` fields are not in the result.
    """
    spark = rows.sparkSession
    known = spark.createDataFrame(sorted({(name, f) for f, names in labels.items() for name in (f, *names)}), "label string, field string").select(label_of(F.col("label")).alias("label"), "field").distinct()
    cells = rows.where((F.col("row_no") < first)).select("file", "row_no", F.posexplode("cells").alias("at", "cell")).withColumn("label", label_of(F.col("cell")))
    met = cells.join(F.broadcast(known), "label").groupBy("file", "row_no", "field").agg(F.min("at").alias("at"))  # the labels are the caller's few
    each = met.groupBy("file", "row_no").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("field", "at"))).alias("columns"))
    best = each.where(F.col("n") >= least).groupBy("file").agg(F.max_by(F.struct("row_no", "columns"), F.struct("n", -F.col("row_no"))).alias("b"))
    return best.select("file", F.col("b.row_no").alias("header"), F.col("b.columns").alias("columns"))


def sheet_records(rows: DataFrame, labels: dict[str, list[str]], first: int = 10, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """``file, row_no`` and a column for each field from the rows below each sheet's header, and the files without one.

    Cells are trimmed, empty ones null; rows without any are left out.
    """
    found = header_rows(rows, labels, first, least)
    met = rows.join(found, "file").where(F.col("row_no") > F.col("header"))
    cell = lambda f: F.nullif(F.trim(F.get("cells", F.try_element_at("columns", F.lit(f)))), F.lit(""))
    values = met.select("file", "row_no", *[cell(f).alias(f) for f in labels])
    return values.where(F.coalesce(*labels).isNotNull()), rows.select("file").distinct().join(found, "file", "left_anti")


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``file, row_no, cells`` of exported sheets without line ends in quotes, every line a row; rows count from 0 within a file."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("row_no", "line"))
    quoted = F.regexp_extract_all("line", F.lit(f'(?:^|{sep})("(?:[^"]|"")*"|[^{sep}]*)'), F.lit(1))
    plain = F.transform(quoted, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return text.select("file", "row_no", plain.alias("cells"))
