"""Repeated passages by collinear chaining (operator 1).

Seeds are winnowed runs of ``SEED`` words: of every ``WINDOW`` neighbouring runs at least one is a seed, the same
one wherever the words recur. Seeds of one document only are found by their hashes alone and leave no task with their
places. All occurrences of a seed are tied to its first occurrence (least doc_id and
place) alone, so a passage in thousands of documents makes one anchor per occurrence. As a short seed may have its first
occurrence in an unrelated text, runs of ``RUN`` words are seeds as well, winnowed so that ``LEAST`` equal words hold one at
least: the document that it is tied to holds all of the run, whatever earlier documents hold of its words. Runs lie at most
``RUN_WINDOW`` words apart, so a long exact passage is covered run by run, by one document or several; the short seeds of a
document that lie inside its tied runs are left out. The anchors that two
documents share are chained: matches in the same order in both, worth ``SEED`` words each, less a cost for the
gaps in both documents; a Fenwick tree over the places in the first document finds the best predecessor. Chains
are then aligned: gaps between anchors word by word, ends by extension over single edits. A chain that
is not alike enough as a whole gives those stretches of it that are. Aligned stretches of
``LEAST_CHAIN`` words or more of one document that overlap or touch are joined, whichever documents they come from, and those of ``LEAST`` words
or more are its repeated passages; the first occurrence of a passage is never one.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters in lower case; null, empty and
shorter texts have no seed; texts of any length are read whole; repeats inside one document alone do not count; rows are told
apart by doc_id and text, so rows of one doc_id with different texts are documents of their own and equal ones are one; rows with a null
doc_id come after all others; of equal places the first counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, numbered, release, table
from .wordhash import U64, Words, bitmap_of, mix, pieces, signed

SEED, WINDOW = 5, 4
GAP_COST, LEAST_CHAIN, LEAST, IDENTITY = 0.1, 16, 50, 0.7
RUN, RUN_WINDOW = 40, LEAST - 40 + 1
AHEAD = (RUN - SEED) // 2  # words of a run before its anchor
MARGIN, LONGEST_GAP = 48, 200
#: So few words from one anchor to the next on one diagonal cost less than an anchor is worth, so a chain never parts there.
NEAR = 24
MEMBERS_PER_SALT = 256
#: Seeds are counted in 2**RANGE_BITS ranges of hashes, out of tasks that hold about HELD_SEEDS of them at once.
RANGE_BITS, HELD_SEEDS = 12, 1 << 20
#: Chains meet their sources in so many rounds, so that the cut words of one round alone are on the way.
ROUNDS = 2
MOST_BITS = 27


def winnow(hashes: np.ndarray, doc: np.ndarray, texts: int, window: int) -> np.ndarray:
    """Places of the minima of all windows of ``window`` neighbours of one text; windows at its end are shorter."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    place = np.arange(len(hashes)) + doc * (window - 1)  # room between texts
    padded = np.full(len(hashes) + texts * (window - 1) + window, np.iinfo(np.uint64).max, dtype=U64)
    padded[place] = hashes
    real = np.zeros(len(padded), bool)
    real[place] = True
    low = np.where(real, _over(padded, window, np.minimum), U64(0))  # the least of each place and those behind it
    high = _over(low[::-1], window, np.maximum)[::-1]  # the greatest of these of each place and those before it
    return np.flatnonzero(high[place] == hashes)


def _over(values: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each place and the ``window - 1`` next ones; the ends have fewer."""
    out, reach = values.copy(), 1
    while reach < window:
        step = min(reach, window - reach)
        out[:-step] = pick(out[:-step], out[step:])
        reach += step
    return out


def _chosen(words: Words, texts: int) -> tuple[np.ndarray, ...]:
    """Hashes of the seeds and runs of a piece, their texts, the places of the ``SEED`` words that anchor them, and which are runs."""
    found = []
    for length, window in ((SEED, WINDOW), (RUN, RUN_WINDOW)):
        hashes, at = words.shingles(length)
        doc = words.doc[at]
        chosen = winnow(hashes, doc, texts, window)
        found.append((hashes[chosen], doc[chosen], at[chosen] - words.first[doc[chosen]] + (length - SEED) // 2, np.full(len(chosen), length == RUN)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _seed_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, seeds): the seeds of each document once, ascending, by range of hashes. Of seeds that many documents of a task hold two are enough."""
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        hashes = np.sort(np.concatenate(held))
        hashes = hashes[np.concatenate([np.ones(min(2, len(hashes)), bool), hashes[2:] != hashes[:-2]])]
        ranges, first = np.unique((hashes >> U64(64 - RANGE_BITS)).astype(np.int32), return_index=True)
        ends = [*first[1:], len(hashes)]
        return pa.RecordBatch.from_arrays([pa.array(ranges), pa.array([hashes[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())], names=["range", "seeds"])

    for batch in batches:
        for part, data, offsets in pieces(batch):
            hashes, doc, _, _ = _chosen(Words(data, offsets), part.num_rows)
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            held.append(hashes[np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])] if len(doc) else hashes)
            n += len(held[-1])
            if n >= HELD_SEEDS:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _seen_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed): the seeds that stand twice or more in a range, whose rows stand together."""
    for _, (seeds,) in _groups(batches, 1):
        hashes = np.sort(np.frombuffer(b"".join(seeds), U64))
        again = hashes[1:][hashes[1:] == hashes[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(again)))], names=["seed"])


def _seeds(repeated):
    """(seed, doc_id, place, run) of the seeds in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                hashes, doc, place, run_of = _chosen(Words(data, offsets), part.num_rows)
                known = repeated.value.has(hashes)
                ids = part.column(0).take(pa.array(doc[known]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[known])), ids, pa.array(place[known].astype(np.int32)), pa.array(run_of[known])], names=["seed", "doc_id", "place", "run"])

    return run


def chain(x: list[int], y: list[int]) -> list[list[int]]:
    """Disjoint chains of anchors (x[i], y[i]), best first: indices in the order of both coordinates.

    An anchor adds ``SEED`` to the chain before it, or less where the two overlap. A tree over y holds the anchors that end
    before the present one in x and is asked for those that end before it in y; the few that overlap it are tried one by one.
    """
    if len(x) == 1:
        return [[0]]
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    ys = sorted(set(y))
    none = (float("-inf"), -1)
    tree: list[tuple[float, int]] = [none] * (len(ys) + 1)  # best score + cost of its place, by prefix of y
    rows: dict[int, tuple[float, int]] = {}  # the same by y alone
    score, before = [0.0] * len(x), [-1] * len(x)
    entered = 0

    for at, i in enumerate(order):
        here, there = x[i], y[i]
        while entered < at and x[order[entered]] <= here - SEED:
            j = order[entered]
            entered += 1
            entry = (score[j] + GAP_COST * (x[j] + y[j]), j)
            if entry > rows.get(y[j], none):
                rows[y[j]] = entry
                r = bisect_left(ys, y[j]) + 1
                while r < len(tree):
                    if entry > tree[r]:
                        tree[r] = entry
                    r += r & -r
        r, best = bisect_right(ys, there - SEED), none
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        cost = GAP_COST * (here + there)
        score[i] = float(SEED)
        if best[0] > cost:
            score[i], before[i] = best[0] - cost + SEED, best[1]
        for near in range(1, SEED):  # ends before in x, overlaps in y
            held = rows.get(there - near)
            if held and held[0] > cost and held[0] - cost + near > score[i]:
                score[i], before[i] = held[0] - cost + near, held[1]
        for j in order[entered:at]:  # overlaps in x
            if x[j] < here and y[j] < there:
                base = score[j] - GAP_COST * (here - x[j] + there - y[j])
                total = base + min(here - x[j], there - y[j], SEED)
                if base > 0 and total > score[i]:
                    score[i], before[i] = total, j
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(path[::-1])
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """Rows with the same first ``keys`` columns, which stand together, as (key values, lists of the other columns)."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != key:
                if key is not None:
                    yield key, held
                key, held = row[:keys], [[] for _ in columns[keys:]]
            for to, v in zip(held, row[keys:]):
                to.append(v)
    if key is not None:
        yield key, held


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of several whole documents at a time; rows of a document, which the first column names, stand together."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if parts and columns[0][-1] != parts[0][0][0]:
            columns, parts = [np.concatenate(c) for c in zip(*parts, columns)], []
        if not parts:
            first = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
            if first:
                yield [c[:first] for c in columns]
            columns = [c[first:].copy() for c in columns]
        parts.append(columns)
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def _lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, src, xs, ys) of anchors (doc, x, src, y, run) sorted by doc and x. Anchors of two documents that all lie as far apart in
    both, each at most ``NEAR`` words behind the one before it, are one chain; others go through ``chain``."""
    names = ["doc", "src", "xs", "ys"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for doc, x, src, y, run in _whole_documents(batches):
        x, y, run = x.astype(np.int64), y.astype(np.int64), run.astype(bool)
        n = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))  # documents by number
        place = (n << 32) + x
        starts = place[run] - AHEAD
        at = np.searchsorted(starts, place, "right") - 1
        keep = np.ones(len(x), bool)
        if len(starts):  # a seed inside a run adds nothing to it
            keep = run | (at < 0) | (starts[at] + RUN < place + SEED)
        doc, x, src, y, n = doc[keep], x[keep], src[keep], y[keep], n[keep]
        order = np.lexsort((src, n))
        doc, x, src, y = doc[order], x[order], src[order], y[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])])
        first = np.flatnonzero(new)
        ahead, apart = np.diff(x, prepend=0), np.diff(y - x, prepend=0)
        plain = np.logical_and.reduceat(new | ((apart == 0) & (ahead > 0) & (ahead <= NEAR)), first)
        size = np.diff(np.append(first, len(x)))
        mine = np.repeat(plain, size)
        ends = np.concatenate([[0], np.cumsum(size[plain])])
        yield pa.RecordBatch.from_arrays([pa.array(doc[first[plain]]), pa.array(src[first[plain]]), _lists(x[mine], ends), _lists(y[mine], ends)], names=names)
        rows = []
        for i, k in zip(first[~plain].tolist(), size[~plain].tolist()):
            d, s, xs, ys = int(doc[i]), int(src[i]), x[i : i + k].tolist(), y[i : i + k].tolist()
            rows += [(d, s, [xs[i] for i in path], [ys[i] for i in path]) for path in chain(xs, ys)]  # single anchors too: alignment may extend them
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _word_rows(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(wanted.value.has(mix(ids.view(U64)))))
            for part, data, offsets in pieces(batch):
                words = Words(data, offsets)
                small = words.hashes.astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([small[a:b].tobytes() for a, b in zip(words.first, words.first[1:])], pa.binary())], names=["key", "words"])

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(batch.column(0).to_numpy().view(U64))))], names=["h"])


def _cut(places: str, result):
    """Hand each chain the words of the document that leads its rows, from ``MARGIN`` before to ``MARGIN`` behind the chain; ``result`` takes
    a batch of chains with the words and their first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words = None, b""
        for batch in batches:
            keys, own, lists = batch.column("key").to_pylist(), batch.column("words"), batch.column(places)
            leads = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            at, cuts, firsts = [], [], []
            for i, j in zip([-1, *leads], [*leads, batch.num_rows]):
                if i >= 0:
                    key, words = keys[i], own[i].as_py()
                tails = [k for k in range(i + 1, j) if keys[k] == key]
                if tails:
                    first = np.maximum(values[ends[tails]] - MARGIN, 0).tolist()
                    last = (values[ends[[k + 1 for k in tails]] - 1] + SEED + MARGIN).tolist()
                    at += tails
                    firsts += first
                    cuts += [words[4 * a : 4 * b] for a, b in zip(first, last)]
            if at:
                yield result(batch.take(pa.array(at)), cuts, firsts)

    return run


def _with_words(chains: pa.RecordBatch, cuts: list[bytes], firsts: list[int]) -> pa.RecordBatch:
    columns = [chains.column(c) for c in ("doc", "src", "xs", "ys")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(cuts, pa.binary()), pa.array(firsts, pa.int32())], names=["doc", "src", "xs", "ys", "cut", "first"])


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Words of ``a`` and ``b`` that an alignment from their beginning covers, and how many are equal; it passes single edits that three equal words follow."""
    a, b = a.tolist(), b.tolist()
    i = j = same = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, same = i + 1, j + 1, same + 1
            continue
        for p, q in ((i + 1, j + 1), (i, j + 1), (i + 1, j), (i + 2, j + 2), (i + 1, j + 2), (i + 2, j + 1)):
            if p + 2 < len(a) and q + 2 < len(b) and a[p] == b[q] and a[p + 1] == b[q + 1] and a[p + 2] == b[q + 2]:
                i, j = p, q
                break
        else:
            break
    return i, j, same


def _aligned(row: list, b: np.ndarray, first_b: int) -> list[tuple]:
    """The stretches of a chain that reach ``IDENTITY``: from each anchor, with the words before it that extend it, as far as
    the share of equal words allows. A chain that reaches it as a whole is one stretch; others part at their gaps."""
    doc, src, xs, ys, cut, first_a = row
    a = np.frombuffer(cut, "<u4")
    x, y = [v - first_a for v in xs], [v - first_b for v in ys]
    n, worth = len(x), lambda same, words: same - IDENTITY * words
    if n == 1:  # what a single anchor and the words on both sides of it come to
        ui, uj, less = extend(a[: x[0]][::-1], b[: y[0]][::-1])
        di, dj, more = extend(a[x[0] + SEED :], b[y[0] + SEED :])
        start, end = xs[0] - ui, xs[0] + SEED + di
        if end - start < LEAST_CHAIN or worth(SEED + less + more, end - start) < -1e-6:
            return []
        return [(doc, src, start, end, ys[0] - uj, ys[0] + SEED + dj, min(SEED + less + more, end - start))]
    core, shift = x[-1] + SEED - x[0], y[0] - x[0]
    if all(q - p == shift for p, q in zip(x, y)) and (a[x[0] : x[0] + core] == b[y[0] : y[0] + core]).all():  # no word differs: one stretch, if its ends allow
        (ui, uj, less), (di, dj, more) = extend(a[: x[0]][::-1], b[: y[0]][::-1]), extend(a[x[-1] + SEED :], b[y[-1] + SEED :])
        start, end = xs[0] - ui, xs[-1] + SEED + di
        if worth(core + less + more, end - start) >= -1e-6:
            return [(doc, src, start, end, ys[0] - uj, ys[-1] + SEED + dj, min(core + less + more, end - start))] if end - start >= LEAST_CHAIN else []
    same, at_x, at_y = 0, x[0], y[0]
    befores, behinds = [extend(a[: x[0]][::-1], b[: y[0]][::-1])], []  # what extends each anchor to the left and to the right
    before, sames, ends = [], [], []  # equal words up to the start and the end of each anchor, and where it ends
    for i, (px, py) in enumerate(zip(x, y)):
        gap_a, gap_b = a[at_x:px], b[at_y:py]
        if i:
            behinds.append(extend(gap_a, gap_b))
            befores.append(extend(gap_a[::-1], gap_b[::-1]))
        if len(gap_a) == len(gap_b):
            same += int((gap_a == gap_b).sum())
        elif len(gap_a) and len(gap_b) and max(len(gap_a), len(gap_b)) <= LONGEST_GAP:
            same += sum(m.size for m in SequenceMatcher(None, gap_a.tolist(), gap_b.tolist(), autojunk=False).get_matching_blocks())
        lap = max(0, at_x - px, at_y - py)  # anchors that overlap in either document
        before.append(same)
        same += max(0, SEED - lap)
        at_x, at_y = max(at_x, px + SEED), max(at_y, py + SEED)
        ends.append((at_x, at_y))
        sames.append(same)
    behinds.append(extend(a[at_x:], b[at_y:]))
    starts = [(max(px, ends[i - 1][0]), max(py, ends[i - 1][1])) if i else (px, py) for i, (px, py) in enumerate(zip(x, y))]
    low = [worth(before[i] - befores[i][2], starts[i][0] - befores[i][0]) for i in range(n)]
    high = [worth(sames[j] + behinds[j][2], ends[j][0] + behinds[j][0]) for j in range(n)]
    most = high[:]  # the greatest of an anchor and all later ones, which never grows
    for j in range(n - 2, -1, -1):
        most[j] = max(most[j], most[j + 1])
    out, reached = [], -1
    for i in range(n):
        j = bisect_right(most, -low[i] + 1e-6, key=lambda v: -v) - 1
        if j < i or j <= reached:
            continue
        reached = j
        (ui, uj, less), (di, dj, more) = befores[i], behinds[j]
        start, end = starts[i][0] - ui + first_a, ends[j][0] + di + first_a
        equal = min(sames[j] - before[i] + more + less, end - start)
        if end - start >= LEAST_CHAIN:
            out.append((doc, src, start, end, starts[i][1] - uj + first_b, ends[j][1] + dj + first_b, equal))
    return out


def _stretches(chains: pa.RecordBatch, cuts: list[bytes], firsts: list[int]) -> pa.RecordBatch:
    kinds = {"doc": pa.int64(), "src": pa.int64(), "start": pa.int32(), "end": pa.int32(), "src_start": pa.int32(), "src_end": pa.int32(), "same": pa.int32()}
    rows = []
    for row, b, first in zip(zip(*[chains.column(c).to_pylist() for c in ("doc", "src", "xs", "ys", "cut", "first")]), cuts, firsts):
        rows += _aligned(row, np.frombuffer(b, "<u4"), first)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())] if rows else [pa.array([], k) for k in kinds.values()], names=list(kinds))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of one document, sorted by start, the longest first, joined where they overlap or touch. A stretch inside one of an
    earlier document names no source of its own. ``farthest``: how far earlier documents reach, ends and documents both ascending."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64())]
    rows = []

    def close(doc, start, end, same, sources):
        if end - start >= LEAST:
            rows.append((doc, start, end, min(1.0, same / (end - start)), sorted(sources)))

    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start_word", "end_word", "identity", "source_ids"])
    for (doc,), (start, end, src, same) in _groups(batches, 1):
        now = None
        for s, e, d, n in zip(start, end, src, same):
            if now is None or s > now[1] + 1:
                if now:
                    close(doc, *now)
                now, farthest = (s, e, n, {d}), [(d, e)]
                continue
            new = max(0, e - max(s, now[1]))
            now = (now[0], max(now[1], e), now[2] + n * new / max(1, e - s), now[3])
            i = bisect_left(farthest, (d,))
            if i == 0 or farthest[i - 1][1] < e:
                now[3].add(d)
                j = i
                while j < len(farthest) and farthest[j][1] <= e:
                    j += 1
                if j > i or i == len(farthest) or farthest[i][0] != d:
                    farthest[i:j] = [(d, e)]
        close(doc, *now)
        if len(rows) >= 5000:
            yield flush()
            rows.clear()
    if rows:
        yield flush()


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start_word, end_word, identity, source_ids``: passages of a document that earlier ones hold."""
    return _passages(docs, text, doc_id).drop("text_hash")


def _passages(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """As ``repeated_passages``, with ``text_hash`` to tell rows of one doc_id apart; it is null where no doc_id is repeated."""
    spark = docs.sparkSession
    rows, names = numbered(docs, text, doc_id)
    slim = rows.select(F.col("node").alias("doc_id"), F.lower("text").alias("text"))
    slim = slim if names is None else durable(slim.dropDuplicates(["doc_id"]), "texts")
    ranges = slim.mapInArrow(_seed_ranges, "range int, seeds binary").repartition("range").sortWithinPartitions("range")
    repeated = durable(ranges.mapInArrow(_seen_twice, "seed long"), "repeated-seeds")
    bits = min(MOST_BITS, max(16, (8 * repeated.count()).bit_length()))  # beyond the most the bitmap only lets more seeds through
    listed = spark.sparkContext.broadcast(bitmap_of(repeated, "seed", bits))
    seeds = durable(slim.mapInArrow(_seeds(listed), "seed long, doc_id long, place int, run boolean"), "seeds")
    release(repeated)
    # The first place of each seed, on its own table: the join below can then split a seed that many documents hold.
    homes = durable(
        seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("home"), F.max("doc_id").alias("last")).where("home.doc_id < last")
        .select("seed", F.col("home.doc_id").alias("src"), F.col("home.place").alias("y")), "seed-homes"
    )
    anchors = seeds.join(homes, "seed").where("doc_id <> src").select(F.col("doc_id").alias("doc"), F.col("place").alias("x"), "src", "y", "run")
    chains = durable(anchors.repartition("doc").sortWithinPartitions("doc", "x", "src", "y").mapInArrow(_chains, "doc long, src long, xs array<int>, ys array<int>"), "chains")
    release(seeds, homes)

    ids = chains.select(F.explode(F.array("doc", "src")).alias("id")).distinct().mapInArrow(_mixed, "h long")
    wanted = spark.sparkContext.broadcast(bitmap_of(ids, "h"))
    words = durable(slim.mapInArrow(_word_rows(wanted), "key long, words binary"), "words")
    blank = {"doc": "long", "src": "long", "xs": "array<int>", "ys": "array<int>", "cut": "binary", "first": "int"}

    def lead(rows: DataFrame, by: str, words: DataFrame) -> DataFrame:
        """The words of document ``by``, then the chains that need them, in partitions that no single document fills."""
        salts = rows.groupBy(by).agg((F.floor(F.count("*") / MEMBERS_PER_SALT) + 1).alias("salts")).withColumnRenamed(by, "key")
        heads = words.join(salts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "words", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
        other = "src" if by == "doc" else "doc"
        tails = rows.withColumn("key", F.col(by)).join(salts, "key").select("key", F.pmod(F.xxhash64(other), F.col("salts")).alias("salt"), F.lit(None).cast("binary").alias("words"), *blank)
        return heads.unionByName(tails).repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("words").isNull())

    bare = chains.withColumns({"cut": F.lit(None).cast("binary"), "first": F.lit(None).cast("int")})
    half = durable(lead(bare, "doc", words).mapInArrow(_cut("xs", _with_words), "doc long, src long, xs array<int>, ys array<int>, cut binary, first int"), "cut-chains")
    release(chains)
    aligned = []
    for i in range(ROUNDS):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(ROUNDS)) == i  # noqa: B023, E731
        met = lead(half.where(mine("src")), "src", words.where(mine("key"))).mapInArrow(_cut("ys", _stretches), "doc long, src long, start int, end int, src_start int, src_end int, same int")
        aligned.append(durable(met.select("doc", "start", "end", "src", "same"), "stretches"))
    release(half, words)
    aligned = reduce(DataFrame.unionByName, aligned)
    stretches = aligned.select("doc", "start", "end", "src", "same").repartition("doc").sortWithinPartitions("doc", "start", F.desc("end"), "src")
    found = stretches.mapInArrow(_joined, "doc_id long, start_word int, end_word int, identity double, source_ids array<long>")
    if names is None:
        return found.withColumn("text_hash", F.lit(None).cast("long"))
    # Nodes back to doc_ids: that of the row, and those of its sources.
    found = durable(found.withColumnRenamed("doc_id", "node"), "node-passages")
    told = names.select(F.col("node").alias("source"), F.col("doc_id").alias("source_id"))
    place = ["node", "start_word", "end_word", "identity"]
    sources = found.select(*place, F.explode("source_ids").alias("source")).join(told, "source").groupBy(*place).agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return sources.join(names, "node").select("doc_id", "start_word", "end_word", "identity", "source_ids", "text_hash")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
        texts = []
        for text, cuts in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), spans):
            if text and cuts:
                raw = text.encode()
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                at, out = 0, []
                for c in sorted((c for c in cuts if c["end_word"] <= len(words.start)), key=lambda c: c["start_word"]):
                    out.append(raw[at : words.start[c["start_word"]]])
                    at = words.end[c["end_word"] - 1]
                text = b"".join([*out, raw[at:]]).decode()
            texts.append(text)
        names = [n for n in batch.schema.names if n != "_spans"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)


def cut_passages(docs: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """``docs`` without the words of their repeated passages, all columns kept. Passages that do not tell rows of one doc_id apart hold for all of them."""
    passages = _passages(docs, "text", "doc_id") if passages is None else passages
    text_hash = F.col("text_hash") if "text_hash" in passages.columns else F.lit(None).cast("long")
    spans = passages.groupBy(F.col("doc_id").alias("_d"), text_hash.alias("_h")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))  # disjoint spans of one text
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_h").isNull() | (F.col("_h") == F.xxhash64(F.coalesce("text", F.lit("")))))
    return docs.join(spans, same, "left").select(*docs.columns, "_spans").mapInArrow(_without, docs.schema)


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
