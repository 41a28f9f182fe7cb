"""Information-theoretic sanitisation of personal data (operator 4).

Base spans are e-mail and IP addresses, payment cards and phone numbers found by pattern and checked. Each found
value is a protected entity. Words near its mentions may reveal it too: over the whole corpus the share
p(e | t) of the documents with word t that mention entity e near t estimates what t discloses. A word is
disclosing if it stands near one entity in ``LEAST_CONTEXTS`` different contexts or more, p(e | t) is at least
``LEAST_SHARE`` and the information log2(p(e | t) / p(e)) above zero and at least ``LEAST_PART`` of the entity's own
information -log2 p(e), so that neither a frequent entity nor a small table is out of reach; all its occurrences in all
texts become spans of the kind ``term``. Values are generalised to their kind, disclosing words removed.

Counts are by document and exact; bitmaps of fixed size, which never miss a word in question, keep all other
words from leaving the tasks. Defined cases: null texts are empty and have no span; equal texts have equal
spans; repeated rows each keep theirs; a null doc_id stays null; an empty table gives an empty result; other
columns are ignored. Words are runs of ASCII letters, digits and non-ASCII characters; ASCII case is ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .wordhash import U64, Words, bitmap_of, pieces, signed

REACH, LEAST_CONTEXTS, LEAST_SHARE, LEAST_PART = 6, 3, 0.5, 0.5
KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that long runs cost no more than their length: a number begins where no digit stands
#: before it and is never given back. An e-mail address is sought from its @: ``LOCAL`` characters before, ``_DOMAIN`` behind.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?+[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: What a text must have for a kind to occur in it.
HINTS = {"ip": ".", "card": "", "phone": "+"}
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(x) < 3 or len(x) == 3 and x <= "255" for x in (part.lstrip("0") for part in found.split(".")))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost addresses that do not overlap, found from their @: what is before it reaches back to the last address or @ at most."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[last:at]
        size = len(before) - len(before.rstrip(LOCAL))
        m = _DOMAIN.match(text, at + 1) if size else None
        if m:
            out.append(("email", at - size, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = _emails(text)
    if _DIGIT.search(text):
        for kind, pattern in PATTERNS.items():
            if HINTS[kind] in text:
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(kind, m[0])]
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in which ASCII case does not count; places stay as they are."""
    return Words(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8), offsets)


def _starts(raw: np.ndarray) -> np.ndarray:
    """The byte at which each character of a UTF-8 text begins, and its end."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


_FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("base_sha256", pa.string()), ("near", pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64())])))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            rows, words = [], None
            for i, (doc_id, text_hash, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist())):
                spans = base_spans(text or "")
                near = []
                if spans:
                    if words is None:
                        words = _words(data, offsets)
                    ends = (words.first[i], words.first[i + 1])
                    places = _starts(data[offsets[i] : offsets[i + 1]]) + int(offsets[i])
                    for kind, a, b in spans:
                        a8, b8 = places[a], places[b]
                        left = np.searchsorted(words.end[ends[0] : ends[1]], a8, side="right") + ends[0]
                        right = np.searchsorted(words.start[ends[0] : ends[1]], b8) + ends[0]
                        around = np.concatenate([words.hashes[max(ends[0], left - REACH) : left], words.hashes[right : min(ends[1], right + REACH)]])
                        value = re.sub("[^0-9a-z@.]" if kind in ("email", "ip") else "[^0-9]", "", text[a:b].lower())
                        entity = int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)
                        context = int.from_bytes(hashlib.blake2b(around.tobytes(), digest_size=8).digest(), "little", signed=True)
                        near += [(entity, context, t) for t in np.unique(signed(around)).tolist()]
                base = _joined(spans)
                counts = [sum(s[0] == k for s in spans) for k in KINDS]
                rows.append((doc_id, text_hash, *counts, base, hashlib.sha256(base.encode()).hexdigest(), near))
            columns = list(zip(*rows))
            near = [[{"entity": e, "context": c, "term": t} for e, c, t in x] for x in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns[:-1], near], _FOUND)], schema=_FOUND)


def _count(wanted):
    """(term, documents): in how many documents of a piece a word of the bitmap occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                words = _words(data, offsets)
                at = np.flatnonzero(wanted.value.has(words.hashes))
                hashes, doc = words.hashes[at], words.doc[at]
                order = np.lexsort((doc, hashes))
                hashes, doc = hashes[order], doc[order]
                if len(hashes):
                    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
                    terms, counts = np.unique(hashes[fresh], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(counts.astype(np.int64))], names=["term", "documents"])

    return run


def _places(wanted):
    """(doc_id, text_hash, term, start, end) of the words of the bitmap, outside base spans, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, data, offsets in pieces(batch):
                words = _words(data, offsets)
                at = np.flatnonzero(wanted.value.has(words.hashes))
                hit, first = np.unique(words.doc[at], return_index=True)
                for d, some in zip(hit.tolist(), np.split(at, first[1:])):
                    starts = _starts(data[offsets[d] : offsets[d + 1]])
                    a = np.searchsorted(starts, words.start[some] - offsets[d])
                    b = np.searchsorted(starts, words.end[some] - offsets[d])
                    taken = np.zeros(len(starts), np.int64)  # of the characters before each one, how many lie in base spans
                    for _, x, y in base_spans(part.column(2)[d].as_py()):
                        taken[x + 1 : y + 1] = 1
                    taken = np.cumsum(taken)
                    free = taken[b] == taken[a]
                    rows += zip([part.column(0)[d].as_py()] * int(free.sum()), [part.column(1)[d].as_py()] * int(free.sum()), words.hashes[some][free].view(np.int64).tolist(), a[free].tolist(), b[free].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, [pa.int64()] * 5)], names=["doc_id", "text_hash", "term", "start", "end"])

    return run


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``term``: hashes of the disclosing words. ``docs``: doc_id, text_hash, text."""
    near = found.select("doc_id", "text_hash", F.explode("near").alias("x")).select("doc_id", "text_hash", "x.*")
    document = F.struct("doc_id", "text_hash")
    together = near.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct(document).alias("both")).where(F.col("contexts") >= LEAST_CONTEXTS)
    together = durable(together, "near-entities")
    if together.isEmpty():
        return together.select("term")
    entities = near.select("entity", "doc_id", "text_hash").distinct().groupBy("entity").agg(F.count("*").alias("mentions"))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(together.select("term").distinct(), "term"))
    spread = docs.mapInArrow(_count(wanted), "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))
    share = F.col("both") / F.col("documents")
    own = -F.log2(F.col("mentions") / F.lit(max(1, found.count())))
    bits = F.log2(share) + own
    return together.join(entities, "entity").join(spread, "term").where((share >= LEAST_SHARE) & (bits > 1e-9) & (bits >= LEAST_PART * own)).select("term").distinct()


def private_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term`` of every row of ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = durable(slim.mapInArrow(_find, f"doc_id long, text_hash long, {counts}, base string, base_sha256 string, near array<struct<entity: long, context: long, term: long>>"), "private-base")
    terms = durable(disclosing(found, slim), "disclosing")
    if terms.isEmpty():
        added = found.select("doc_id", "text_hash").limit(0).withColumns({"more": F.lit(""), "n_term": F.lit(0)})
    else:
        wanted = slim.sparkSession.sparkContext.broadcast(bitmap_of(terms, "term"))
        places = slim.mapInArrow(_places(wanted), "doc_id long, text_hash long, term long, start long, end long").join(terms, "term", "left_semi")
        spans = F.array_sort(F.collect_set(F.struct("start", "end")))  # spans of one text
        said = F.transform("s", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string")))
        added = places.groupBy("doc_id", "text_hash").agg(spans.alias("s")).select("doc_id", "text_hash", F.array_join(said, ",").alias("more"), F.size("s").alias("n_term"))
    added = added.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    met = found.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more")
    return met.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.coalesce("n_term", F.lit(0)).cast("long").alias("n_term"), "text_hash")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = []
        for text, spans in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("_spans")).to_pylist()):
            at, out = 0, []
            for a, b, kind in sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in (spans or "").split(",") if s)):
                if a >= at:  # of spans that overlap the first is replaced, and what is beyond it goes as well
                    out += [text[at:a], "" if kind == "term" else f"[{kind.upper()}]"]
                at = max(at, b)
            texts.append("".join([*out, text[at:]]) if out else text)
        kept = [n for n in names if n != "_spans"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(names.index(n)) for n in kept], names=kept)


def sanitise(docs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``docs`` with values generalised to their kind and disclosing words removed, all columns kept. Of spans that overlap the first is named."""
    spans = (private_spans(docs) if spans is None else spans).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("spans").alias("_spans")).where("_spans <> ''").distinct()
    met = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h")), "left").drop("_d", "_h")
    return met.mapInArrow(_rewrite, docs.schema)


def op4_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents")).drop("text_hash")
