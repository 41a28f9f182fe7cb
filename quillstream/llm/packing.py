"""Best-fit packing of tokenised documents into sequences (operator 3).

Documents become pieces of at most ``capacity`` tokens. The histogram of piece lengths, at most ``capacity``
numbers, is all that the driver needs. Over it stands the configuration linear program: cover the count of
every length with as few sequences as possible, a configuration being a multiset of lengths that fits. It is
solved by multiplicative weights: in each phase the price of a length falls with its excess coverage, a
knapsack dynamic program finds for all capacities the dearest content, and every length that lags behind is
covered by the dearest configuration that holds it. The fractions are rounded down, then up while the counts
allow, and what is left is packed best-fit by decreasing length, all in bulk on counts; where best-fit alone needs
fewer sequences, which happens at small counts, it is taken. The resulting plan says
for each length which ranks go to which slot; Spark ranks the pieces of each length and looks the slots up.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

CAPACITY, END_ID = 2048, 0
PHASES, ETA = 48, 4.0
#: Words whose ids a worker remembers, twice over at a turnover: some 250 MB.
CACHED_WORDS = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Bytes of a word's ids. White space separates words for the tokenizer too, so ids of a text are those of its words in turn."""

    #: Words for which lower case and Unicode normal form are plain, and a run of signs, which the tokenizer takes apart from letters;
    #: others take its whole way.
    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!#$%&*|]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.old: dict[bytes, bytes] = {}  # what was known before the last turnover; a word in use comes back from there
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}  # byte-level BPE writes bytes as these

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _modelled(self, symbols: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(word)) is not None:
            pass
        elif (core := word.rstrip(b".,")).isalpha():  # ASCII letters, which are their own symbols
            if len(core) < len(word):
                ids = self[core.lower()] + self[word[len(core) :]]
            else:
                ids = self._modelled(word.decode()) if word.islower() else self[word.lower()]
        elif m := self.PLAIN.fullmatch(text := word.decode()):
            core, tail = m[1].lower(), m[2]
            if core == text:
                ids = self._modelled(word.decode("latin1").translate(self.symbols))
            else:
                ids = self[core.encode()] + (self[tail.encode()] if tail else b"")
        else:
            ids = self._whole(text)
        self[word] = ids
        return ids


_loaded: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _loaded.get(path) or _loaded.setdefault(path, WordIds(path))
        part, seen, end = TaskContext.get().partitionId(), Counter(), END_ID.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("turn", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = b"".join(map(ids.__getitem__, (text.as_py() or "").encode().split())) + end
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    cut = body[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


# ---- the plan: configurations with their numbers of sequences -------------------------------------------------


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity``: the dearest content's worth and one length of it (index, -1: none)."""
    price_of = np.full(capacity + 1, -np.inf)
    price_of[lengths] = prices
    index_of = np.full(capacity + 1, -1)
    index_of[lengths] = np.arange(len(lengths))
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth = price_of[1 : room + 1] + best[room - 1 :: -1] if room > 1 else price_of[1:2] + best[:1]
        at = int(worth.argmax())
        if worth[at] > best[room - 1]:
            best[room], last[room] = worth[at], index_of[at + 1]
        else:
            best[room], last[room] = best[room - 1], -2  # a room unit stays empty
    return best, last


def _content(room: int, lengths: list[int], last: list[int]) -> list[int]:
    out = []
    while room > 0 and last[room] != -1:
        if last[room] == -2:
            room -= 1
        else:
            out.append(last[room])
            room -= lengths[last[room]]
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, phases: int = PHASES, eta: float = ETA) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations ((length index, number), ...) with fractional numbers of sequences that cover all counts."""
    covered, answer = np.zeros(len(lengths)), Counter()
    as_list = lengths.tolist()
    for phase in range(1, phases + 1):
        target = counts * (phase / phases)
        excess = np.maximum(covered - counts * ((phase - 1) / phases), 0) / np.maximum(counts / phases, 1e-9)
        weights = lengths / capacity * np.exp(-eta * np.minimum(excess, 8.0))
        last = _knapsack(lengths, weights, capacity)[1].tolist()
        for i in np.argsort(-lengths, kind="stable"):
            lack = target[i] - covered[i]
            if lack > 1e-9:
                inside = Counter([int(i), *_content(capacity - as_list[i], as_list, last)])
                number = lack / inside[int(i)]
                answer[tuple(sorted(inside.items()))] += number
                for j, k in inside.items():
                    covered[j] += number * k
    return answer


def best_fit(lengths: list[int], left: list[int], capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on counts: sequences with equal content move together."""
    open_: list[list] = []  # [room, content, number]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, n = lengths[i], left[i]
        while n:
            fitting = [g for g in open_ if g[0] >= size]
            if fitting:
                group = min(fitting, key=lambda g: g[0])
                each = group[0] // size
                full, rest = divmod(n, each)
                if full >= group[2]:
                    moved, n = group[2], n - group[2] * each
                    group[0] -= each * size
                    group[1] = group[1] + Counter({i: each})
                    continue
                if full:
                    group[2] -= full
                    open_.append([group[0] - each * size, group[1] + Counter({i: each}), full])
                if rest:
                    group[2] -= 1
                    open_.append([group[0] - rest * size, group[1] + Counter({i: rest}), 1])
                    if not group[2]:
                        open_.remove(group)
                n = 0
            else:
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    open_.append([capacity - each * size, Counter({i: each}), full])
                if rest:
                    open_.append([capacity - rest * size, Counter({i: rest}), 1])
                n = 0
    return [(g[1], g[2]) for g in open_]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Contents {length: number} with the number of sequences of each; every piece of the histogram has its slot."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    as_list = lengths.tolist()
    left = [histogram[x] for x in as_list]
    answer = fractional(lengths, np.array(left, float), capacity)
    whole: Counter = Counter()
    ordered = sorted(answer.items(), key=lambda x: (-x[1], x[0]))
    ordered_up = sorted(answer.items(), key=lambda x: (int(x[1]) - x[1], x[0]))
    for up, configurations in ((False, ordered), (True, ordered_up)):
        for inside, number in configurations:
            n = min(1 if up else int(number), *(left[i] // k for i, k in inside))
            if n and (not up or sum(as_list[i] * k for i, k in inside) >= capacity - 2):
                whole[inside] += n
                for i, k in inside:
                    left[i] -= n * k
    done = [(dict(x), n) for x, n in whole.items()] + [(dict(x), n) for x, n in best_fit(as_list, left, capacity)]
    plain = [(dict(x), n) for x, n in best_fit(as_list, [histogram[x] for x in as_list], capacity)]
    done = min(done, plain, key=lambda packed: sum(n for _, n in packed))  # rounding can cost a sequence where counts are small
    return [({as_list[i]: k for i, k in inside.items()}, n) for inside, n in done]


def slots(planned: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, number a sequence, first sequence, offset), in the order of length and rank."""
    rows, base, used = [], 0, Counter()
    for inside, n in planned:
        offset = 0
        for length, k in sorted(inside.items(), reverse=True):
            rows.append((length, used[length], k, base, offset))
            used[length] += n * k
            offset += length * k
        base += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        key = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = rows[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            copy, turn = np.divmod(rank - at[:, 1], np.maximum(at[:, 2], 1))
            columns = [*batch.columns[:5], pa.array(at[:, 3] + copy), pa.array(at[:, 4] + turn * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    spark = docs.sparkSession
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _pieces(tokenizer or default_tokenizer(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, turn long"
    )
    cut = durable(cut, "pieces")
    by_part = cut.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))  # bounded by phases and capacity, not by the corpus
    ranked = cut.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("turn")).alias("rank"))
    return ranked.mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
