"""Rows that share a doc_id or have none: every operator tells them apart by their texts."""

import random

from pyspark.sql import functions as F
from test_small import edited, frame, prose

from quillstream.llm import contamination, line_dedup, near_dup, passages


def test_op2_rows_of_one_doc_id(spark):
    rows = [(1, "alpha beta gamma\nown line of the first row", "en", "s"), (2, "first\nalpha beta gamma\nlast", "en", "s"), (2, "other words here\nkept one\nalpha beta gamma", "en", "s"), (None, "alpha  BETA\tgamma\nnull row", "en", "s")]
    docs = frame(spark, rows)
    cut = line_dedup.cut_lines(docs, line_dedup.repeated_lines(docs))
    assert sorted((r.doc_id or 0, r.text) for r in cut.collect()) == [(0, "null row"), (1, rows[0][1]), (2, "first\nlast"), (2, "other words here\nkept one")]
    assert cut.columns == docs.columns


def test_op1_rows_of_one_doc_id(spark):
    rng = random.Random(4)
    shared, one, two, three = prose(rng, 120), prose(rng, 40), prose(rng, 30), prose(rng, 20)
    rows = [(1, shared, "en", "s"), (2, f"{one} {shared}", "en", "s"), (2, two, "en", "s"), (2, two, "en", "s"), (None, f"{three} {shared} {three[::-1]}", "en", "s")]
    docs = frame(spark, rows)
    got = sorted((r.doc_id or 0, r.start_word, r.source_ids) for r in passages.repeated_passages(docs).collect())
    assert got == [(0, 20, [1]), (2, 40, [1])]
    cut = passages.cut_passages(docs)
    left = [(r.doc_id, r.text.split()) for r in cut.collect()]
    assert cut.columns == docs.columns and len(left) == 5
    assert (2, one.split()) in left and left.count((2, two.split())) == 2 and (None, three.split() + three[::-1].split()) in left


def test_op5_rows_of_one_doc_id(spark):
    rng = random.Random(5)
    item = prose(rng, 40).split()
    rows = [(1, " ".join(item[:22]), "en", "s"), (1, " ".join(item[18:]), "en", "s"), (None, " ".join(item), "en", "s"), (None, prose(rng, 50), "en", "s"), (3, " ".join(item), "en", "s"), (3, prose(rng, 20), "en", "s")]
    docs, items = frame(spark, rows), spark.createDataFrame([(9, " ".join(item))], "item_id int, text string")
    assert sorted(r.doc_id or 0 for r in contamination.contained_items(docs, items).collect()) == [0, 3]  # two halves are no whole
    left = contamination.clean_of(docs, items)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted(rows[i][1] for i in (0, 1, 3, 5))


def test_op5_sketch_never_loses():
    """Whatever an item may miss, enough of its sketch is left, and no more is asked for."""
    for n in range(1, 3000):
        k, need = contamination.sketch_size(n, 0.8)
        misses = max(m for m in range(n + 1) if (n - m) / n >= 0.8)
        assert 1 <= need == k - misses and k <= n


def test_op7_rows_of_one_doc_id(spark):
    rng = random.Random(6)
    a, b, c = prose(rng, 90), prose(rng, 90), prose(rng, 90)
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (1, b, "en", "s"), (2, edited(rng, b, 1), "en", "s"), (None, a, "en", "s"), (None, c, "en", "s"), (None, c + " end", "en", "s")]
    docs = frame(spark, rows)
    got = near_dup.near_duplicates(docs)
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got.collect()) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 1)]
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = sorted(r.text for r in kept.collect())
    assert texts == sorted([a, b, min((c, c + " end"), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])])


def test_words_with_signs_take_no_whole_way():
    """Ids of a word are the tokenizer's, and letters with signs behind them are not encoded whole, which costs some four times as much."""
    from quillstream.llm import packing

    ids = packing.WordIds(packing.default_tokenizer())
    words = "thing Thing THING thing. Thing,. thing&&& schzu,$$$ Élan été%%% wow!! a|b a|| it's don't! x1 555-0399 <|endoftext|> a<|endoftext|> ... ," .split()
    want, whole, seen = {w: ids._whole(w) for w in words}, ids._whole, []
    ids._whole = lambda text: seen.append(text) or whole(text)
    assert {w: ids[w.encode()] for w in words} == want
    assert not {"thing&&&", "schzu,$$$", "été%%%", "wow!!", "a||"} & set(seen)
