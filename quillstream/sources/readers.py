"""Files to text rows: format dispatch, text, CSV sheets, word-processor files, workbooks exported as sheets.

Operators: O-SRC-1 to O-SRC-20. Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do;
a file that is too large, of another kind, without text or broken becomes a row with an error and never stops the batch
(Spark's file sources pass over files of no bytes).
Binary PDF and XLSX parsing need libraries that are not here (O-SRC-10, O-SRC-13: sheets arrive exported).
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

MOST_BYTES = 15 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Labels that mark a sheet of questions and answers.
QUESTION_HEADERS, ANSWER_HEADERS = ("question", "questions", "q", "query", "faq"), ("answer", "answers", "a", "response", "reply")


def kind_of(name: Column, mime: Column | None = None) -> Column:
    """By extension, and where that says nothing by MIME type (O-SRC-1)."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    told = F.when(ext.isin("txt", "text"), "txt").when(ext.isin("md", "markdown"), "md").when(ext.isin("csv", "tsv"), "csv").when(ext.isin("docx", "pdf"), ext)
    if mime is None:
        return told
    told = told.when(F.contains(mime, F.lit("wordprocessingml")), "docx").when(mime == "application/pdf", "pdf")
    return told.when(mime == "text/csv", "csv").when(mime == "text/markdown", "md").when(F.startswith(mime, F.lit("text/")), "txt")


def looks_right(content: Column, kind: Column) -> Column:
    """Whether the first bytes fit the kind (O-SRC-12)."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(kind == "docx", F.startswith(head, F.lit("504B0304"))).when(kind == "pdf", head == "255044462D").otherwise(F.lit(True))


def docx_markdown(data: bytes) -> str:
    """Headings, list items and paragraphs of a word-processor file (O-SRC-9)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{_W}p"):
        runs = []
        for x in p.iter():
            runs.append(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "")
        line = "".join(runs).strip()
        if not line:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.search(r"(?i)heading\s*([1-6])", style.get(f"{_W}val", "")) if style is not None else None
        item = p.find(f"{_W}pPr/{_W}numPr") is not None
        out.append("#" * int(level[1]) + " " + line if level else f"- {line}" if item else line)
    return "\n\n".join(out)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _from_docx(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            rows.append((docx_markdown(data), None))
        except Exception as e:  # a broken file is a result, not a failure of the batch
            rows.append((None, f"cannot be read: {type(e).__name__}"))
    return pd.DataFrame(rows, columns=["text", "error"])


def csv_markdown(content: str) -> tuple[str, str | None]:
    """A sheet as Markdown, and a note on blank rows: blocks of questions and answers where its labels name both, else numbered
    records. A file of less than a label row and one more is an error (O-SRC-4 to O-SRC-8)."""
    rows = list(csv.reader(io.StringIO(content, newline=""), delimiter=delimiter(content)))
    filled = [[c.strip() for c in row] for row in rows if any(c.strip() for c in row)]
    if len(filled) < 2:
        raise ValueError("a sheet needs labels and a row")
    blank = len(rows) - len(filled)
    note = f"{blank} blank row{'s' * (blank > 1)} skipped" if blank else None
    labels, body = [re.sub(r"\s+", " ", c) for c in filled[0]], filled[1:]
    low = [c.lower() for c in labels]
    q, a = (next((i for i, c in enumerate(low) if c in names), None) for names in (QUESTION_HEADERS, ANSWER_HEADERS))
    named = lambda row: [(i, label, value) for i, (label, value) in enumerate(zip(labels, row)) if label and value]
    if q is None or a is None:
        return "\n".join(f"- Row {n} — " + " · ".join(f"**{label}:** {value}" for _, label, value in named(row)) for n, row in enumerate(body, 1)), note
    blocks = []
    for row in body:
        if max(q, a) < len(row) and row[q] and row[a]:
            more = " · ".join(f"_{label}: {value}_" for i, label, value in named(row) if i not in (q, a))
            blocks.append(f"## {row[q]}\n\n{row[a]}" + (f"\n\n{more}" if more else ""))
    if not blocks:
        raise ValueError("no row has a question and an answer")
    return "\n\n".join(blocks), note


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("note", T.StringType()), T.StructField("error", T.StringType())]))
def _from_csv(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            rows.append((*csv_markdown(data), None))
        except (ValueError, csv.Error) as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["text", "note", "error"])


def ingest(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """``filename, kind, bytes, title, text, error, note`` of every file (O-SRC-20)."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("filename"), F.col("length").alias("bytes"), "content").withColumn("kind", kind_of(F.col("filename")))
    error = (
        F.when(F.col("bytes") > most, "file too large").when(F.col("kind").isNull(), "unsupported type")
        .when(~looks_right(F.col("content"), F.col("kind")), "content does not match its type").when(F.col("kind") == "pdf", "no text layer reader here")
    )
    checked = rows.withColumn("error", error)
    word = checked.where("error is null and kind = 'docx'").withColumn("_d", _from_docx("content")).withColumns({"text": F.col("_d.text"), "error": F.col("_d.error")}).drop("_d")
    plain = checked.where("error is not null or kind <> 'docx'").withColumn("text", F.when(F.col("error").isNull(), text.decode_text(F.col("content"))))
    plain = plain.withColumn("note", F.lit(None).cast("string"))
    sheets = plain.where("error is null and kind = 'csv'").withColumn("_d", _from_csv("text")).withColumns({c: F.col(f"_d.{c}") for c in ("text", "note", "error")}).drop("_d")
    plain = plain.where("error is not null or kind <> 'csv'").unionByName(sheets)
    both = plain.unionByName(word, allowMissingColumns=True).withColumn("text", text.tidy_space(F.col("text")))
    none = F.col("error").isNull() & (F.coalesce(F.trim("text"), F.lit("")) == "")
    return both.select("filename", "kind", "bytes", text.title_of(F.col("filename")).alias("title"), "text", F.when(none, "no text found").otherwise(F.col("error")).alias("error"), "note")


def delimiter(sample: str) -> str:
    """``;`` where it outnumbers ``,`` outside quotes in the first 4000 characters (O-SRC-5)."""
    bare = re.sub(r'"[^"]*"', "", sample[:4000])
    return ";" if bare.count(";") > bare.count(",") else ","


def sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with quotes, embedded line ends and ragged rows (O-SRC-4), all columns text, blank rows out (O-SRC-6)."""
    rows = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    filled = F.exists(F.array(*[F.col(f"`{c}`") for c in rows.columns]), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return rows.where(filled)


def normal_headers(rows: DataFrame) -> DataFrame:
    """Labels collapsed, trimmed and in lower case."""
    return rows.toDF(*[re.sub(r"\s+", " ", c).strip().lower() for c in rows.columns])


def question_sheet(rows: DataFrame) -> DataFrame | None:
    """``question, body``: question and answer blocks with the other columns as extras, or None for another sheet (O-SRC-7)."""
    named = normal_headers(rows)
    q, a = (next((c for c in named.columns if c in names), None) for names in (QUESTION_HEADERS, ANSWER_HEADERS))
    if q is None or a is None:
        return None
    extras = [F.when(F.coalesce(F.trim(f"`{c}`"), F.lit("")) != "", F.concat(F.lit(f"_{c}: "), F.trim(f"`{c}`"), F.lit("_"))) for c in named.columns if c not in (q, a)]
    kept = named.where((F.coalesce(F.trim(f"`{q}`"), F.lit("")) != "") & (F.coalesce(F.trim(f"`{a}`"), F.lit("")) != ""))
    more = F.concat_ws(" · ", *extras) if extras else F.lit("")
    body = F.concat(F.lit("## "), F.trim(f"`{q}`"), F.lit("\n\n"), F.trim(f"`{a}`"), F.when(more != "", F.concat(F.lit("\n\n"), more)).otherwise(""))
    return kept.select(F.trim(f"`{q}`").alias("question"), body.alias("body"))


def records(rows: DataFrame) -> DataFrame:
    """``body``: labelled rendering of each row (O-SRC-8); the caller numbers rows where the source has an order."""
    parts = [F.when(F.coalesce(F.trim(f"`{c}`"), F.lit("")) != "", F.concat(F.lit(f"**{c}:** "), F.trim(f"`{c}`"))) for c in rows.columns]
    return rows.select(F.concat(F.lit("- "), F.concat_ws(" · ", *parts)).alias("body"))


#: What a snapshot may hold; fields that it lacks are null.
SNAPSHOT = "docs array<struct<id:string,title:string,kind:string,filename:string,bytes:bigint>>, chunks array<struct<id:string,docId:string,index:int,headings:array<string>,text:string,embedding:array<float>>>"


def snapshot(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and passages of a JSON snapshot {docs: [...], chunks: [...]} (O-SRC-17); with a schema, a malformed one has none."""
    whole = spark.read.json(path, schema=schema, multiLine=True)
    return whole.select(F.explode("docs").alias("d")).select("d.*"), whole.select(F.explode("chunks").alias("c")).select("c.*")
