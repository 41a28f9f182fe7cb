"""Queries over sources that may fail and sheets whose headers are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, shared_dir
from ..sources import isolated
from .registry import query

_PROPS = "case when event_id % 7 = 0 then left(props, length(props) - 1) else props end"


@query(
    """select 'customers' as source, 'ok' as state, count(*) as rows, 0::bigint as corrupt from customer union all select 'events', case when count(*) filter (event_id % 7 = 0) > 0 then 'partial' else 'ok' end, count(*) filter (event_id % 7 > 0), count(*) filter (event_id % 7 = 0) from events
 union all select 'missing', 'failed', 0, 0 union all select 'mistyped', 'failed', 0, 0 union all select 'unasked', 'skipped', 0, 0"""
)
def src_isolated(spark: SparkSession, d: str) -> DataFrame:
    """O-JOIN-16: five sources, one with damaged lines, one missing, one of other types than stated, one not asked for."""
    lines = f"{shared_dir(spark)}/lines-{spark.sql('select uuid()').first()[0]}"
    load(spark, d, "events").select(F.expr(_PROPS).alias("value")).write.text(lines)
    sources = [
        isolated.Source("customers", f"{d}/customer.parquet", "c_custkey long, c_name string"), isolated.Source("events", lines, "k int", "json"), isolated.Source("missing", f"{d}/no_such_table.parquet", "x int"),
        isolated.Source("mistyped", f"{d}/orders.parquet", "o_orderkey array<int>"), isolated.Source("unasked", f"{d}/part.parquet", "p_partkey long", wanted=False),
    ]
    return isolated.gather(spark, sources).report.select("source", "state", "rows", "corrupt")


_LABELS = {"a": ["the", "los", "die"], "b": ["of", "de", "und"], "c": ["and", "la", "in"]}


@query(
    """with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as row_no from documents),
 cells as (select doc_id, row_no, unnest(string_split(line, ' ')) as cell, unnest(range(len(string_split(line, ' ')))) as pos from lines where row_no < 10),
 named as (select *, trim(regexp_replace(lower(cell), '[^\\p{L}\\p{N}]+', ' ', 'g')) as label from cells),
 met as (select doc_id, row_no, case when label in ('a', 'the', 'los', 'die') then 'a' when label in ('b', 'of', 'de', 'und') then 'b' else 'c' end as field, min(pos) as pos from named where label in ('a', 'the', 'los', 'die', 'b', 'of', 'de', 'und', 'c', 'and', 'la', 'in') group by 1, 2, 3),
 each as (select doc_id, row_no, count(*) as n, max(pos) filter (field = 'a') as a, max(pos) filter (field = 'b') as b, max(pos) filter (field = 'c') as c from met group by 1, 2 having count(*) >= 2)
 select doc_id, row_no as header, a, b, c from (select *, row_number() over (partition by doc_id order by n desc, row_no) as r from each) where r = 1"""
)
def src_header_rows(spark: SparkSession, d: str) -> DataFrame:
    """O-SRC-13: every document as a sheet of lines and words, its header the line with most of the labels."""
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("row_no", "line")).select("file", F.col("row_no").cast("long").alias("row_no"), F.split("line", " ").alias("cells"))
    found = isolated.header_rows(rows, _LABELS)
    return found.select(F.col("file").alias("doc_id"), "header", *[F.try_element_at("columns", F.lit(f)).cast("long").alias(f) for f in _LABELS])
