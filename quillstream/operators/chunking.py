"""Passages of a document: heading sections, split to size with overlap.

Operators: O-TVF-1 to O-TVF-4, O-STR-4, O-STR-5, O-WIN-11. Packing depends on the order of paragraphs, so one small
function runs per document inside Spark tasks; the rest are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TARGET, MOST, LEAST, OVERLAP = 900, 1400, 220, 160
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_SENTENCE = re.compile(r"[^.!?]+[.!?]+\s?|[^.!?]+$")
_BOUNDARY = re.compile(r"[.!?]\s")
_NUMBER = re.compile(r"\d[\d,.]*")
# End of fixed values.
HELD = 1_000_000  # characters of passages that a task holds
_KINDS = {"doc_id": pa.int64(), "idx": pa.int32(), "headings": pa.list_(pa.string()), "body": pa.string()}


def sections(text: str) -> Iterator[tuple[list[str], str]]:
    """(headings from the outermost in, body) of each section with a body (O-TVF-1)."""
    path: list[str] = []
    lines: list[str] = []

    def close() -> Iterator[tuple[list[str], str]]:
        if body := "\n".join(lines).strip():
            yield [h for h in path if h.strip()], body

    for line in text.split("\n"):
        if m := _HEADING.match(line):
            yield from close()
            lines = []
            level = len(m[1])
            path = (path[: level - 1] + [""] * (level - 1 - len(path)))[: level - 1] + [m[2]]
        else:
            lines.append(line)
    yield from close()


def _packed(pieces: list[str], most: int, glue: str) -> Iterator[str]:
    now = ""
    for p in pieces:
        if now and len(now) + len(p) > most:
            yield now.strip()
            now = ""
        now += (glue if now and glue else "") + p
    if now.strip():
        yield now.strip()


def overlap(text: str) -> str:
    """What the next passage repeats of this one (O-STR-5)."""
    tail = text[-OVERLAP:]
    if len(text) > OVERLAP:
        if m := _BOUNDARY.search(tail):
            tail = tail[m.start() + 2 :]
        elif "\n" in tail:
            tail = tail[tail.index("\n") + 1 :]
        if sum(len(_NUMBER.findall(x)) >= 2 for x in tail.split("\n")) >= 2:
            return ""
        tail = tail.strip()
    return f"{tail}\n\n" if tail else ""


def split(body: str) -> list[str]:
    """O-TVF-2."""
    if len(body) <= MOST:
        return [body]
    parts: list[str] = []
    for paragraph in re.split(r"\n\s*\n", body):
        if paragraph.strip():
            parts += _packed(_SENTENCE.findall(paragraph) or [paragraph], TARGET, "") if len(paragraph) > MOST else [paragraph]
    out: list[str] = []
    now = ""
    for p in parts:
        if now and len(now) + len(p) + 2 > TARGET:
            out.append(now)
            now = overlap(now) + p
        else:
            now = f"{now}\n\n{p}" if now else p
    if now.strip():
        if out and len(now) < LEAST:
            out[-1] += f"\n\n{now}"
        else:
            out.append(now)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of a batch, handed on whenever ``HELD`` characters are together: what a task holds does not depend on how many texts a batch has."""
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            doc_id, text = doc_id.as_py(), text.as_py()
            i = 0
            for headings, body in sections(text or ""):
                for piece in split(body):
                    if re.search("[A-Za-z0-9]{2}", " ".join([*headings, piece])):
                        rows.append((doc_id, i, headings, piece))
                        i += 1
                        held += len(piece) + sum(map(len, headings))
                        if held > HELD:
                            yield _made(rows)
                            rows, held = [], 0
            if not i and text and text.strip():
                rows.append((doc_id, 0, [], text.strip()))
                held += len(text)
        if rows:
            yield _made(rows)


def _made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS.values())], names=list(_KINDS))


def chunk(docs: DataFrame) -> DataFrame:
    """``id, doc_id, idx, headings, body`` of every passage (O-TVF-3)."""
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, "doc_id long, idx int, headings array<string>, body string")
    return made.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("id"), "doc_id", "idx", "headings", "body")


def indexed_text(title: Column, headings: Column, body: Column) -> Column:
    """What a passage is indexed by (O-TVF-4)."""
    return F.concat_ws("\n", title, F.array_join(headings, "\n"), body)
