"""Repeated passages that the chaining or the seeding could lose."""

import random

import numpy as np
import pytest

from quillstream.llm import passages
from quillstream.llm.wordhash import U64, Words

from test_small import frame, prose


@pytest.mark.parametrize("sizes", [(80, 70, 80), (80, 100, 80), (100, 200, 100), (300, 300, 300), (500, 600, 500)])
def test_op1_head_and_foot_round_own_words(spark, sizes):
    """Two shared passages in the same order are found however many own words stand between them."""
    rng = random.Random(sum(sizes))
    head, foot = prose(rng, sizes[0]), prose(rng, sizes[2])
    rows = [(i, f"{head} {prose(rng, sizes[1])} {foot}", "en", "s") for i in range(3)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {1, 2}
    for i in (1, 2):
        covered = {w for r in got if r.doc_id == i for w in range(r.start_word, r.end_word)}
        shared = {*range(sizes[0]), *range(sizes[0] + sizes[1], sum(sizes))}
        assert len(shared - covered) <= 16 and len(covered - shared) <= 16  # the ends of exact passages extend at most by chance
    assert all(r.identity >= passages.IDENTITY for r in got)


def test_op1_chains_that_are_alike_stay_whole(spark):
    """Parts of under 50 words each are one passage where the whole is alike enough."""
    rng = random.Random(3)
    one, two = prose(rng, 40), prose(rng, 40)
    rows = [(i, f"{prose(rng, 60)} {one} {prose(rng, 15)} {two} {prose(rng, 60)}", "en", "s") for i in range(2)]
    (r,) = passages.repeated_passages(frame(spark, rows)).collect()
    assert r.doc_id == 1 and 60 <= r.start_word <= 62 and 153 <= r.end_word <= 155


def test_op1_recall_on_edited_passages(spark):
    """Passages of 60 words with one changed word every ``step``, in random text, are found; all are above IDENTITY."""
    rng, rows, steps = random.Random(12), [], (6, 8, 12, 15, 20)
    for k in range(40):
        for at, step in enumerate(steps):
            passage = prose(rng, 60, 10**6).split()
            other = [f"e{rng.randrange(10**9)}" if n % step == step - 1 else w for n, w in enumerate(passage)]
            for half, words in enumerate((passage, other)):
                rows.append((1000 * k + 2 * at + half, f"{prose(rng, 80, 10**6)} {' '.join(words)} {prose(rng, 80, 10**6)}", "en", "s"))
    found = {r.doc_id for r in passages.repeated_passages(frame(spark, rows)).collect() if r.start_word < 95 and r.end_word > 125}
    recall = {step: sum(1000 * k + 2 * at + 1 in found for k in range(40)) / 40 for at, step in enumerate(steps)}
    print(recall)
    assert all(recall[step] == 1 for step in (8, 12, 15, 20)) and recall[6] >= 0.9, recall


def covered(rows, spark):
    out = {}
    for r in passages.repeated_passages(frame(spark, rows)).collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


@pytest.mark.parametrize(("size", "fragment"), [(60, 9), (60, 25), (300, 30), (300, 120), (51, 12)])
def test_op1_exact_passages_after_earlier_fragments(spark, size, fragment):
    """What two documents share is found whole though earlier documents hold each part of it."""
    rng = random.Random(size + fragment)
    shared, rows = prose(rng, size, 10**6).split(), []
    for n, at in enumerate(range(0, size - fragment + 1, 2)):
        rows.append((n, f"{prose(rng, 40, 10**6)} {' '.join(shared[at : at + fragment])} {prose(rng, 40, 10**6)}", "en", "s"))
    rows += [(i, f"{prose(rng, 80, 10**6)} {' '.join(shared)} {prose(rng, 80, 10**6)}", "en", "s") for i in (1000, 1001)]
    assert set(range(80, 80 + size)) <= covered(rows, spark).get(1001, set())


def exact_repeats(texts):
    """Words of each text that lie in ``LEAST`` equal words or more of an earlier one."""
    known, out = set(), {}
    for i, words in enumerate(texts):
        runs = [tuple(words[k : k + passages.LEAST]) for k in range(len(words) - passages.LEAST + 1)]
        out[i] = {k + d for k, run in enumerate(runs) if run in known for d in range(passages.LEAST)}
        known.update(runs)
    return out


@pytest.mark.parametrize("documents", [30, 120, 360])
def test_op1_recall_does_not_fall_as_documents_are_added(spark, documents):
    """Against brute force: documents cut from shared passages at random places, so that most short runs recur elsewhere first."""
    rng = random.Random(documents)
    stock = [prose(rng, 150, 10**6).split() for _ in range(12)]
    texts = []
    for _ in range(documents):
        words = []
        for _ in range(rng.randrange(2, 8)):
            passage, n = rng.choice(stock), rng.choice([6, 9, 15, 30, 60, 110])
            at = rng.randrange(len(passage) - n + 1)
            words += passage[at : at + n] + prose(rng, rng.randrange(0, 30), 10**6).split()
        texts.append(words)
    got = covered([(i, " ".join(w), "en", "s") for i, w in enumerate(texts)], spark)
    want = exact_repeats(texts)
    lost, total = sum(len(want[i] - got.get(i, set())) for i in want), sum(map(len, want.values()))
    assert total > 500 and lost <= 0.01 * total, (lost, total)


@pytest.mark.parametrize("window", [1, 2, 4, 11])
def test_op1_winnow_takes_the_least_of_each_window(window):
    rng = random.Random(window)
    sizes = [rng.randrange(0, 40) for _ in range(30)]
    doc = np.repeat(np.arange(30), sizes)
    hashes = np.array([rng.randrange(1, 500) for _ in doc], U64)
    want, first = set(), 0
    for n in sizes:
        for k in range(n):
            part = hashes[first + k : first + min(n, k + window)]
            want |= {first + k + int(j) for j in np.flatnonzero(part == part.min())}
        first += n
    assert passages.winnow(hashes, doc, 30, window).tolist() == sorted(want)


def test_op1_runs_are_hashed_by_their_words():
    words = Words(np.frombuffer(b"a b c d e f g a b c d e f g", np.uint8), np.array([0, 27]))
    for n in (1, 2, 3, 5, 6, 7):
        hashes, at = words.shingles(n)
        assert at.tolist() == list(range(15 - n)) and len(set(hashes.tolist())) == (7 if n < 9 and 15 - n >= 7 else 15 - n) and hashes[0] == hashes[7]
