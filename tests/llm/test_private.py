"""Disclosing words of frequent entities and of small tables."""

import collections
import math
import random
import re
import time

import pytest
from test_small import frame, prose

from quillstream.llm import private_data


@pytest.mark.parametrize("rows", [12, 300])
def test_op4_frequent_entity(spark, rows):
    """An address in a third of all rows has disclosing words, on a table of any size; words of all rows disclose nothing."""
    rng = random.Random(rows)
    said = [f"{prose(rng, 20)} Zorblax the desk@corp.example the {prose(rng, 20)}" if i % 3 == 0 else f"{prose(rng, 20)} the {prose(rng, 20)}" for i in range(rows)]
    got = {r.doc_id: r for r in private_data.private_spans(frame(spark, [(i, t, "en", "s") for i, t in enumerate(said)])).collect()}
    for i, t in enumerate(said):
        words = {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if k == "term"}
        assert words == ({"Zorblax"} if i % 3 == 0 else set())


#: The patterns of the contract as they are given.
GIVEN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def test_op4_same_as_given_patterns():
    rng = random.Random(3)
    signs = ["a", "@", ".", "1", "12", "0", "255", "256", "-", " ", "+", "(", ")", "é", "b.c", "\n", "4111111111111111"]
    found = 0
    for _ in range(20000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        want = [(k, m.start(), m.end()) for k, p in GIVEN.items() for m in p.finditer(text) if private_data.holds(k, m[0])]
        assert private_data.base_spans(text) == want
        found += len(want)
    assert found > 5000


@pytest.mark.parametrize("text", ["a" * 10**6, "a" * 10**6 + "@" + "b" * 10**6, "1" * 10**6, "a@" * 500_000, "1." * 500_000, "+1 -" * 250_000, "1 " * 500_000, "0" * 6000 + ".1.1.1"])
def test_op4_long_runs(text):
    """A text of a million characters takes a time that grows with its length, whatever it repeats."""
    began = time.process_time()
    private_data.base_spans(text)
    assert time.process_time() - began < 20


def test_op4_disclosure_by_counts(spark):
    """The disclosing words are those that plain counts over all documents give."""
    rng = random.Random(9)
    names = [f"name{i}" for i in range(12)]
    texts = []
    for i in range(240):
        e = rng.randrange(6)
        near = [names[2 * e], names[2 * e + 1]] if rng.random() < 0.8 else rng.sample(names, 2)
        texts.append(f"{prose(rng, 12)} {near[0]} {near[1]} user{e}@corp{e}.example {prose(rng, 12)} {rng.choice(names) if rng.random() < 0.4 else ''}" if i % 2 else f"{prose(rng, 30)} {rng.choice(names)}")
    texts += texts[:5]  # repeated rows
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    word = re.compile(r"[0-9a-z]+")
    has, mentions, both, contexts = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t in texts:
        low = t.lower()
        has.update(set(word.findall(low)))
        near = collections.defaultdict(set)
        for m in GIVEN["email"].finditer(t):
            around = word.findall(low[: m.start()])[-private_data.REACH :] + word.findall(low[m.end() :])[: private_data.REACH]
            for w in around:
                near[m[0]].add(w)
                contexts[m[0], w].add(tuple(around))
        mentions.update(near.keys())
        both.update((e, w) for e, ws in near.items() for w in ws)
    want = set()
    for (e, w), n in both.items():
        own = -math.log2(mentions[e] / len(texts))
        bits = math.log2(n / has[w]) + own
        if len(contexts[e, w]) >= private_data.LEAST_CONTEXTS and n / has[w] >= private_data.LEAST_SHARE and bits > 1e-9 and bits >= private_data.LEAST_PART * own:
            want.add(w)
    got = set()
    for r in private_data.private_spans(docs).collect():
        got |= {texts[r.doc_id][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"}
    assert got == {w for w in want if not w.startswith("user")} and got
