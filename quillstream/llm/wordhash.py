"""Words, shingles and fixed-size bitmaps over Arrow batches, as whole-array numpy work inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Batches are worked on in pieces of about so many bytes of text, which bounds a task's memory.
PIECE_BYTES = 500_000
_ODD = U64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + U64((seed * int(_ODD)) & (2**64 - 1)))


#: A random number for each byte value, so that the polynomial below does not act on small ones.
_BYTES = seeded(np.arange(256, dtype=U64), 7)
#: True for the bytes that words are made of: ASCII letters and digits, and all of longer characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_known.get(base, ())) < n:
        out = np.full(max(n, PIECE_BYTES + 1), base & (2**64 - 1), dtype=U64)
        out[0] = 1
        _known[base] = np.cumprod(out, dtype=U64)
    return _known[base][:n]


class Words:
    """The words of several texts: ``hashes``, and for word i its text ``doc[i]`` and bytes ``start[i]`` to ``end[i]`` of ``data``.

    ``first[t]`` is the number of words before text t, for t up to the number of texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD):
        flags = np.zeros(len(data) + 2, bool)  # one false in front and one behind
        np.take(word, data, out=flags[1:-1])
        cut = np.zeros(len(data) + 1, bool)  # where a text begins: a word never runs over it
        cut[offsets] = True
        edge = (flags[1:] != flags[:-1]) | cut
        start = np.flatnonzero(edge & flags[1:])
        end = np.flatnonzero(edge & flags[:-1])
        self.data, self.start, self.end = data, start, end
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        self.first = np.searchsorted(start, offsets)
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTES[data] * _powers(_BASE, len(data)), out=sums[1:], dtype=U64)
        self.hashes = mix((sums[end] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(U64))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside one text, and the number of the first word of each."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        total, power, length = self.hashes, _STEP, 1  # runs of twice as many words from two of them, and of one more where ``n`` has the bit
        for bit in bin(n)[3:]:
            total, power, length = total[:-length] * U64(power) + total[length:], power * power & (2**64 - 1), 2 * length
            if bit == "1":
                total, power, length = total[:-1] * U64(_STEP) + self.hashes[length:], power * _STEP & (2**64 - 1), length + 1
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        return mix(total[at]), at


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with the bytes and offsets of its string column; null counts as empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Bitmap:
    """A set of hashes that says yes to all it holds and to few others. Its size is fixed, whatever it holds."""

    def __init__(self, bits: int = 22, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), U64) if words is None else words

    def _places(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [(hashes >> U64(shift)) & U64((1 << self.bits) - 1) for shift in (0, 64 - self.bits)]

    def add(self, hashes: np.ndarray) -> None:
        for p in self._places(hashes):
            np.bitwise_or.at(self.words, p >> U64(6), U64(1) << (p & U64(63)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in self._places(hashes):
            found &= (self.words[p >> U64(6)] >> (p & U64(63))) & U64(1) != 0
        return found


def bitmap_of(df, column: str, bits: int = 22) -> Bitmap:
    """The bitmap of a BIGINT column of hashes: at most ``2**(bits - 6)`` rows reach the driver, however long ``df`` is."""
    from pyspark.sql import functions as F

    mask = (1 << bits) - 1
    place = F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 64 - bits)))
    rows = df.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    out = Bitmap(bits)
    for chunk in rows.toArrow().to_batches():
        out.words[chunk.column(0).to_numpy()] = chunk.column(1).to_numpy().view(U64)
    return out


def signed(hashes: np.ndarray) -> np.ndarray:
    """As Spark's BIGINT."""
    return hashes.view(np.int64)
