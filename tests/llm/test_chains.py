"""Chains of op1 out of batches of anchors, and the words that they are handed."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import passages

SCHEMA = pa.schema([("doc", pa.int64()), ("x", pa.int32()), ("src", pa.int64()), ("y", pa.int32()), ("run", pa.bool_())])


def _in_batches(rows, size):
    return [pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows[i : i + size]], SCHEMA) for i in range(0, len(rows), size)]


def _made(rows, size=1000):
    return sorted((r["doc"], r["src"], r["xs"], r["ys"]) for b in passages._chains(iter(_in_batches(rows, size))) for r in b.to_pylist())


def test_op1_anchors_of_one_diagonal_are_one_chain():
    """Anchors that overlap each other on one diagonal leave none behind as a chain of its own."""
    xs = [0, 1, 2, 4, 6, 7, 10, 14, 38, 40]
    assert _made([(7, x, 3, x + 100, False) for x in xs]) == [(7, 3, xs, [x + 100 for x in xs])]
    far = [0, 2, 4, 4 + passages.NEAR + 200]  # too far for one chain
    assert len(_made([(7, x, 3, x + 100, False) for x in far])) > 1


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_op1_chains_over_batches(size):
    """Documents may begin and end anywhere in a batch or fill several; every anchor outside of runs is in a chain of its two documents."""
    rng = random.Random(5)
    rows = set()
    for doc in range(10, 30):
        for _ in range(rng.choice([1, 2, 40])):
            src, x, shift = rng.randrange(3), rng.randrange(400), rng.choice([0, 0, 5])
            rows |= {(doc, x + i, src, x + i + shift, False) for i in range(0, rng.randrange(1, 30), 3)}
        if doc % 3 == 0:
            rows.add((doc, 100, 1, 100, True))
    rows = sorted(rows)
    got = _made(rows, size)
    assert got == _made(rows)
    want = set()
    for doc, x, src, y, run in rows:
        inside = any(d == doc and r and a - passages.AHEAD <= x and x + passages.SEED <= a - passages.AHEAD + passages.RUN for d, a, _, _, r in rows)
        if run or not inside:
            want.add((doc, src, x, y))
    assert {(d, s, x, y) for d, s, xs, ys in got for x, y in zip(xs, ys)} == want
    for d, s, xs, ys in got:
        assert xs == sorted(xs) and ys == sorted(ys)


def test_op1_words_cut_over_batches():
    kinds = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("doc", pa.int64()), ("src", pa.int64()), ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32())), ("cut", pa.binary()), ("first", pa.int32())])
    words = {k: np.arange(k * 1000, k * 1000 + 200, dtype="<u4") for k in (1, 2)}
    rows = []
    for k, places in ((1, [[0, 9], [100], [190]]), (2, [[60, 70, 120]])):
        rows.append({"key": k, "words": words[k].tobytes()})
        rows += [{"key": k, "doc": k, "src": 9, "xs": p, "ys": [0] * len(p)} for p in places]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], kinds) for i in range(0, len(rows), size)]
        out = [r for b in passages._cut("xs", passages._with_words)(iter(batches)) for r in b.to_pylist()]
        assert [(r["doc"], r["xs"]) for r in out] == [(1, [0, 9]), (1, [100]), (1, [190]), (2, [60, 70, 120])]
        for r in out:
            first = max(0, r["xs"][0] - passages.MARGIN)
            assert r["first"] == first and r["cut"] == words[r["doc"]][first : r["xs"][-1] + passages.SEED + passages.MARGIN].tobytes()


def test_op1_equal_words_are_one_stretch(monkeypatch):
    """A chain without a differing word is extended at its two ends alone; a chain with one gives the same stretch with one equal word less."""
    calls, extend = [], passages.extend
    monkeypatch.setattr(passages, "extend", lambda a, b: calls.append(1) or extend(a, b))
    a = np.arange(300, dtype="<u4")
    b = np.concatenate([np.arange(900, 910), a[20:250], np.arange(800, 830)]).astype("<u4")
    xs = [*range(30, 90, 3), *range(100, 240, 4)]
    row = [5, 2, xs, [x - 10 for x in xs], a.tobytes(), 0]
    assert passages._aligned(row, b, 0) == [(5, 2, 20, 250, 10, 240, 230)]
    assert len(calls) == 2
    b[85] = 777  # between the anchors at 87 and 100
    assert passages._aligned(row, b, 0) == [(5, 2, 20, 250, 10, 240, 229)]
