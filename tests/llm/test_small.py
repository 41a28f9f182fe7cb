"""Corpus operators on small tables: brute force, round trips and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import contamination, html_text, line_dedup, near_dup, packing, passages, private_data, quality_model, quality_rules, sharding
from quillstream.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, piece string, score string, a int, b int, label string, node int, spans string"
WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 1, "p", "q", 1, 2, "l", 3, "s") for i, t, la, s in rows], SCHEMA)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(7)}" for _ in range(n))


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 300)) for _ in range(60)]
    passage = prose(rng, 70)
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s0") for i in range(30)]  # exact copies
    rows += [(200 + i, edited(rng, base[1] + " " + base[2], i % 9), "en", "s0") for i in range(50)]  # a large family of near copies
    rows += [(300 + i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40), "de", "s1") for i in range(8)]
    rows += [(400, None, "en", None), (401, "", None, None), (402, " \n\t ", "en", "s0"), (403, "one", "en", "s0"), (404, "one", "en", "s0"), (405, "a b c d", "en", "s0"), (405, "a b c d", "en", "s0"), (None, "null id row", "en", "s0"), (-7, prose(rng, 9000), "en", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def bag(text):
    w = WORD.findall((text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def alike(a, b):
    both = sum((a & b).values())
    either = sum(a.values()) + sum(b.values()) - both
    return both >= 0.8 * either if either else True


def classes_by_force(rows):
    bags = {i: bag(t) for i, t, *_ in rows if i is not None}
    up = {i: i for i in bags}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if alike(bags[i], bags[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_op7_against_all_pairs(docs, corpus, none):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == classes_by_force(corpus)
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    want = sorted({c for c in classes_by_force(corpus).values()})
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.keep_first(none).count() == 0


def test_op7_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    shingle = rng.integers(0, 2**44, 300).astype(np.uint64)
    w1, w2 = rng.integers(1, 40, 300), rng.integers(1, 40, 300)
    doc = np.repeat([0, 1], 300)
    agree = []
    for turn in range(30):
        s = np.tile(near_dup.seeded(shingle, turn) >> np.uint64(20), 2)
        t = near_dup.signatures(doc, s, np.concatenate([w1, w2]), 2)
        assert np.isfinite(t).all()
        agree.append((t[0] == t[1]).mean())
    truth = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs(np.mean(agree) - truth) < 0.03


def test_op7_large_family_blocks(spark, monkeypatch):
    """A family without a middle that is similar to all: members are found block by block."""
    monkeypatch.setattr(near_dup, "SMALL", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(1)
    text, rows = prose(rng, 400), []
    for i in range(40):  # a walk: neighbours are similar, the ends are not
        rows.append((i, text, "en", "s"))
        text = edited(rng, text, 3)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes_by_force(rows)


def lines_by_force(rows):
    seen, out = [], {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if t}, key=lambda r: (r[0] is None, r[0] or 0)):  # rows without a doc_id come last
        for n, line in enumerate(t.lower().split("\n")):
            if s := frozenset(line.split()):
                hit = next(((a, b) for a, b, o in seen if 5 * len(s & o) >= 4 * len(s | o)), None)
                if hit:
                    out[(i, n)] = hit
                seen.append((i, n, s))
    return out


def test_op2_against_all_pairs(spark, none, monkeypatch):
    rng = random.Random(2)
    lines = [prose(rng, rng.randrange(3, 40), 60) for _ in range(120)]
    rows = [(i, "\n".join(edited(rng, x, rng.randrange(3)) if rng.random() < 0.5 else x for x in rng.sample(lines, rng.randrange(1, 9))), "en", "s") for i in range(60)]
    rows += [(70, None, None, None), (71, "", "en", "s"), (72, "a\n\n  \na b\nA b c\na b  C", "en", "s"), (73, "A b c", "en", "s"), (None, "a b c", "en", "s")]
    for hot in (line_dedup.HOT, 1):  # all words cold; all words hot
        monkeypatch.setattr(line_dedup, "HOT", hot)
        docs = frame(spark, rows).repartition(3)
        gone = line_dedup.repeated_lines(docs)
        assert {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in gone.collect()} == lines_by_force(rows)
    cut = line_dedup.cut_lines(docs, gone)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = {r.doc_id: r for r in cut.collect()}
    assert texts[72].text == "a\n\n  \na b\nA b c" and texts[73].text == "" and texts[73].n_chars == 0 and texts[70].text is None and texts[None].text == ""
    assert line_dedup.repeated_lines(none).count() == 0


def test_op1_finds_passages(docs, corpus, none):
    got = collections.defaultdict(list)
    for r in passages.repeated_passages(docs).collect():
        got[r.doc_id].append(r)
    assert {i for i in got if 300 <= i < 400} == set(range(301, 308))  # the first occurrence stays
    for i in range(301, 308):
        (p,) = got[i]
        assert p.source_ids == [300] and 69 <= p.end_word - p.start_word <= 74 and 38 <= p.start_word <= 41
    words = {i: WORD.findall((t or "").lower()) for i, t, *_ in corpus if i is not None}
    assert {i for i in got if 100 <= i < 130} == (set(range(100, 130)) if len(words[0]) >= 50 else set())
    assert {i for i in got if 201 <= i < 250} == set(range(201, 250))
    assert not any(3 <= i < 60 or i > 399 or i < 0 for i in got)
    cut = passages.cut_passages(docs, passages.repeated_passages(docs))
    assert cut.count() == len(corpus) and "w" in cut.where("doc_id = 305").first().text
    assert passages.repeated_passages(none).count() == 0


def test_op1_chains():
    x, y = [0, 10, 20, 30, 400, 25], [5, 15, 25, 35, 8, 500]
    paths = passages.chain(x, y)
    assert paths[0] == [0, 1, 2, 3] and sorted(sum(paths, [])) == list(range(6))
    rng = random.Random(4)
    for _ in range(50):  # the Fenwick tree finds what all pairs find
        n = rng.randrange(1, 25)
        x, y = [rng.randrange(60) for _ in range(n)], [rng.randrange(60) for _ in range(n)]
        order = sorted(range(n), key=lambda i: (x[i], y[i]))
        best = {}
        for i in order:
            gains = [best[j] - passages.GAP_COST * (x[i] + y[i] - x[j] - y[j]) + min(passages.SEED, x[i] - x[j], y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i] and best[j] - passages.GAP_COST * (x[i] + y[i] - x[j] - y[j]) > 0]
            best[i] = max([float(passages.SEED), *gains])
        longest = passages.chain(x, y)[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(longest, longest[1:]))
        worth = passages.SEED + sum(min(passages.SEED, x[b] - x[a], y[b] - y[a]) - passages.GAP_COST * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(longest, longest[1:]))
        assert worth == pytest.approx(max(best.values()))


def test_op3_packs_all(spark, docs, corpus, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    odd = [(900, "Ünïted, it's don't 1234 <|endoftext|> x<|startoftext|>y naïve café é ΣΑΣ ... \x1c tab\tend", "en", "s"), (901, "日本語 text, MIXED!! 😀", "en", "s")]
    both = docs.unionByName(frame(spark, odd))
    rows = packing.pack(both).collect()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    want = {}
    for i, t, *_ in corpus + odd:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want.setdefault((i, k // 2048), []).append((k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())))
    assert got == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    rooms = []  # plain best-fit decreasing, piece by piece
    for n in sorted((r.length for r in rows), reverse=True):
        at = min((k for k, room in enumerate(rooms) if room >= n), key=rooms.__getitem__, default=None)
        if at is None:
            rooms.append(2048 - n)
        else:
            rooms[at] -= n
    least = max(-(-sum(r.length for r in rows) // 2048), sum(r.length > 1024 for r in rows))
    assert least <= len(sequences) <= len(rooms) and len(sequences) <= 1.02 * least + 1
    assert packing.pack(none).count() == 0


def test_op3_plan_is_near_the_bound():
    rng = random.Random(9)
    for spread in (900, 1500, 2048):
        histogram = collections.Counter(rng.randrange(1, spread + 1) for _ in range(3000))
        planned = packing.plan(dict(histogram))
        used = collections.Counter()
        for inside, n in planned:
            assert sum(k * c for k, c in inside.items()) <= 2048
            for k, c in inside.items():
                used[k] += n * c
        assert used == histogram
        sequences, least = sum(n for _, n in planned), -(-sum(k * c for k, c in histogram.items()) // 2048)
        least = max(least, sum(c for k, c in histogram.items() if k > 1024))
        assert sequences <= 1.01 * least + 2


def test_op4_base_and_terms(spark, none):
    texts = ["mail bob.a+b@x-y.co.uk, and a@b not", "at 10.0.0.256 or 192.168.1.1 or 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (415) 555-2671 now or +12", None, "", "x" * 50000 + " 4111111111111111"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(20 + i, f"{prose(random.Random(i), 20)} Zorblax wrote zed@corp.example from here {prose(random.Random(i + 50), 20)}", "en", "s") for i in range(5)]
    rows += [(40, "only Zorblax here", "en", "s"), (None, "zed@corp.example", "en", "s")] + [(60 + i, prose(random.Random(i + 500), 30), "en", "s") for i in range(400)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in private_data.private_spans(docs).collect()}
    assert len(got) == len(rows)
    assert got[0].spans == "email:5:22" and got[0].base_sha256 == hashlib.sha256(b"email:5:22").hexdigest()
    one, two = texts[1].index("192.168.1.1"), texts[1].index("1.2.3.4")
    assert (got[1].n_ip, got[1].spans) == (2, f"ip:{one}:{one + 11},ip:{two}:{two + 7}")
    assert (got[2].n_card, got[2].spans, got[3].n_phone, got[3].spans) == (1, "card:5:24", 1, "phone:5:22")
    assert got[4].spans == got[5].spans == "" and got[5].base_sha256 == hashlib.sha256(b"").hexdigest() and got[6].n_card == 1
    at = rows[7][1].index("Zorblax")
    assert f"term:{at}:{at + 7}" in got[20].spans and got[60].spans == ""
    assert got[40].spans == "term:5:12,term:13:17"  # "here" stands in the same documents as Zorblax, near the same address, so it discloses as much
    clean = {r.doc_id: r.text for r in private_data.sanitise(docs).collect()}
    assert clean[0] == "mail [EMAIL], and a@b not" and "Zorblax" not in clean[20] and "[EMAIL]" in clean[20] and clean[4] is None
    assert private_data.private_spans(none).count() == 0


def test_op5_against_all_pairs(spark, docs, corpus, none):
    rng = random.Random(8)
    items = [(i, prose(rng, 12 + i)) for i in range(40)] + [(90, "too short item"), (91, None), (92, "")]
    held = [(500 + i, prose(rng, 3000) + " " + t + ". " + prose(rng, 500), "en", "s") for i, t in items[:40]] + [(600, edited(rng, items[39][1], 1), "en", "s"), (601, items[5][1].upper(), "en", "s"), (602, items[20][1][: len(items[20][1]) // 2], "en", "s")]
    both = docs.unionByName(frame(spark, held))
    shingles = lambda t: {k for k in bag(t)} if len(WORD.findall((t or "").lower())) >= 5 else set()
    want = {}
    for j, q in ((j, shingles(t)) for j, t in items):
        for i, s in ((i, shingles(t)) for i, t, *_ in corpus + held):
            if q and len(q & s) >= 0.8 * len(q):
                want[(i, j)] = len(q & s)
    table = spark.createDataFrame(items, "item_id int, text string")
    assert {(r.doc_id, r.item_id): r.n_shared for r in contamination.contained_items(both, table).collect()} == want and len(want) >= 41
    clean = contamination.clean_of(both, table)
    assert clean.columns == both.columns and clean.count() == both.count() - len({i for i, _ in want})
    assert contamination.contained_items(none, table).count() == 0 and contamination.contained_items(both, table.limit(0)).count() == 0


def test_op6_counts(docs, corpus, spark, none):
    extra = [(700, "a b c a b c a b c d", "en", "s"), (701, "x y\n\nx y\n \nx y # $", "en", "s"), (702, "the cat sat. " * 40, "en", "s"), (703, " ".join(f"q{i}" for i in range(30)) + " a b c z a b c " + prose(random.Random(1), 60), "en", "s")]
    both = docs.unionByName(frame(spark, extra))
    got = collections.defaultdict(list)
    for r in quality_rules.judge(both).collect():
        got[r.doc_id].append(r)
    for i, t, *_ in corpus + extra:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.defaultdict(list)
        for k in range(len(w) - 2):
            grams[tuple(w[k : k + 3])].append(k)
        covered = {k + d for places in grams.values() if len(places) > 1 for k in places for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i].pop()
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0


def test_op6_adapts(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80), "en", "plain") for i in range(300)] + [(1000 + i, prose(rng, 60) + " | " * 20 + prose(rng, 20), "en", "tables") for i in range(300)]
    rows += [(5000, prose(rng, 60) + " | " * 40, "en", "plain"), (5001, prose(rng, 60) + " | " * 20 + prose(rng, 20), "en", "tables")]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert not kept[5000] and kept[5001] and sum(kept.values()) == len(rows) - 1


def test_op6_fences_stay_open(spark):
    """A few symbols in long texts of a clean group reject nobody, nor do words a little longer where most texts are copies; junk beyond a gap is rejected."""
    rng = random.Random(26)
    rows = [(i, prose(rng, 2000) + " # # # #" * (i < 20) + " # $" * 200 * (i >= 390), "en", "clean") for i in range(400)]
    copy = prose(rng, 100)
    rows += [(1000 + i, copy if i % 20 else prose(rng, 100), "en", "copies") for i in range(300)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert {i for i, k in kept.items() if not k} == set(range(390, 400))


def test_op6_against_plain_quantiles(spark):
    """Every verdict follows from quantiles of plain sorted lists; groups of one, a few and some hundred documents, a null lang."""
    rng = random.Random(16)
    rows = []
    for lang, source, n in (("en", "a", 180), ("en", "b", 40), ("de", "a", 1), (None, "c", 25), ("de", None, 120)):
        for _ in range(n):
            text = prose(rng, rng.randrange(50, 90)) + " #" * rng.choice([0] * 20 + [1, 4, 30]) + "".join(f"\nsame line {rng.randrange(4)}" for _ in range(rng.choice([0] * 30 + [9])))
            rows.append((len(rows), text, lang, source))
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    rates = {c: {i: getattr(got[i], c) for i in got if not got[i].base_failed} for c in quality_rules.FEATURES}

    lengths = {i: (r.n_words, (rows[i][1] or "").count("\n") + 1) for i, r in got.items()}

    def quantile(values, q):
        return sorted(values)[max(0, math.ceil(q * len(values) - 1e-9) - 1)]

    def fence(c, members, q):
        values = [rates[c][i] for i in members]
        middle, at = quantile(values, 0.5), quantile(values, q)
        least = 0.05 * middle if c == "word_length" else 1 / quantile([lengths[i][c == "dup_line_ratio"] for i in members], 0.9)
        for t in (0.925, 0.95, 0.975, 0.99):
            if t > max(q, 1 - q):
                further = quantile(values, t if q > 0.5 else 1 - t)
                if abs(further - at) > quality_rules.TAIL * max(abs(at - middle), least):
                    break
                at = further
        return at + (1 if q > 0.5 else -1) * quality_rules.TAIL * max(abs(at - middle), least)

    rejected = 0
    for i, _, lang, source in rows:
        good = not got[i].base_failed
        for c, (_, _, _, sides) in quality_rules.FEATURES.items():
            if not good:
                break
            own = [j for j in rates[c] if rows[j][2:4] == (lang, source)]
            wide = [j for j in rates[c] if rows[j][2] == lang]
            for side, q in zip(("low", "high"), sides):
                if q is not None:
                    p, w = len(own) / (len(own) + quality_rules.BORROW), len(wide) / (len(wide) + quality_rules.BORROW)
                    edge = p * fence(c, own, q) + (1 - p) * (w * fence(c, wide, q) + (1 - w) * fence(c, list(rates[c]), q))
                    good = good and (rates[c][i] >= edge - 1e-12 if side == "low" else rates[c][i] <= edge + 1e-12)
        assert got[i].kept == good, i
        rejected += not good and not got[i].base_failed
    assert rejected > 5


def test_op8_learns(spark, none):
    rng = random.Random(7)
    rows = [(i, prose(rng, 60) if i % 2 else " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split()), "en", "s") for i in range(400)] + [(900, None, None, None), (901, "", "en", "s"), (None, "text", "en", "s")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, labels)
    got = {r.doc_id: r for r in quality_model.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(out)) for i in range(400))
    assert sum(got[i].predicted == i % 2 for i in out) >= 0.97 * len(out)
    again = quality_model.train(docs, labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(again.weights, model.weights)  # labels of held-out rows have no part in it
    kept = quality_model.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())
    assert quality_model.score(none, model).count() == 0
    flat = quality_model.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality_model.score(docs, flat).collect()} == {0.5}


def test_op8_interactions_by_pairs():
    rng = np.random.default_rng(1)
    size = quality_model.BUCKETS + quality_model.STATS
    m = quality_model.Machine(0.1, rng.normal(size=size), rng.normal(size=(size, quality_model.FACTORS)), np.zeros(quality_model.STATS), np.ones(quality_model.STATS))
    row, bucket, stats = np.array([0, 0, 1]), np.array([3, 9, 9]), rng.normal(size=(2, quality_model.STATS))
    rows, index, value = m.lay_out(row, bucket, stats)
    raw, _ = m.margin(rows, index, value, 2)
    for d in range(2):
        i, x = index[rows == d], value[rows == d]
        slow = m.bias + m.weights[i] @ x + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert raw[d] == pytest.approx(slow)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_op9_shards(docs, corpus, none, shards):
    rows = sharding.minimax_shards(docs, shards).collect()
    assert len(rows) == len(corpus)
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = collections.defaultdict(list)
    where = collections.defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(x) == 1 for x in where.values())
    assert sharding.minimax_shards(none, shards).count() == 0


def test_op9_capacity_is_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 4)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    rng = random.Random(3)
    for shards in (2, 5, 24):
        groups = sorted((rng.randrange(-(2**63), 2**63), rng.randrange(1, 1000)) for _ in range(300))
        sizes = [b for _, b in groups]
        firsts = sharding.boundaries(spark.createDataFrame(groups, "key long, bytes long"), shards)
        load = collections.Counter(sum(k >= f for f in firsts) for k, b in groups for _ in range(b))
        low, high = max(sizes), sum(sizes)
        while low < high:
            middle, n, room = (low + high) // 2, 1, 0
            room = middle
            for s in sizes:
                if s > room:
                    n, room = n + 1, middle
                room -= s
            low, high = (low, middle) if n <= shards else (middle + 1, high)
        assert max(load.values()) == low


def test_op10_pages(spark):
    page = """<html><head><title>T</title><script>var a = "</p><p>no";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><header class=site><p>Site name, slogan, and more</p></header>
<div class="cookie-notice"><p>We use cookies, many, many, many of them, all the time, for you.</p></div><article><h1>Head &amp; line</h1><p><b>First   paragraph, with&nbsp;<a href=x>link</a>.<br><p>Second &#233;t&eacute;, a &lt;b&gt;.
next</p><form><p>Your name</p></form><aside><p>Related, related, related</p></aside></article><section id="comments"><p>I like it, very, very, very, very much, thanks, really, a lot.</p></section><footer>c 2024</footer>"""
    rows = [(1, "u", page, 5), (2, "u", None, 5), (3, None, "", 5), (None, "u", "plain, no tags", 5), (4, "u", "<div>" * 3000 + "deep text" + "</div>" * 3000, 5), (5, "u", "<p>x <!-- open", 5), (5, "u", "<p>x <!-- open", 5)]
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()]
    want = "Head & line\n\nFirst paragraph, with link.\n\nSecond été, a <b>. next"
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (None, "plain, no tags", 14), (4, "deep text", 9), (5, "x", 1), (5, "x", 1)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (60, 100), (70, 60)] + [(200, 200 + i) for i in range(1, 40)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 50 for i in (50, 60, 70, 100)}, **{200 + i: 200 for i in range(40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
