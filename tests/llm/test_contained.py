"""Items whose size made the candidate filter lose them."""

import random

from test_small import frame, prose

from quillstream.llm import contamination


def test_op5_short_items_in_many_documents(spark):
    """An item of five words is one shingle: every document that holds it is found."""
    rng = random.Random(1)
    items = [(k, prose(rng, 5, 10**6)) for k in range(80)]
    rows = [(i, f"{prose(rng, 40)} {items[i % 80][1]} {prose(rng, 40)}", "en", "s") for i in range(4000)]
    got = contamination.contained_items(frame(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 80) for i in range(4000)} and all(r.n_shared == r.n_item == 1 for r in got)


def test_op5_long_items_above_a_class(spark):
    """Items of 1,030 and 5,000 shingles, held in part or whole, are counted exactly."""
    rng = random.Random(2)
    items = [(n, prose(rng, n + 4, 10**6)) for n in (1030, 5000)]
    rows = [(n + part, " ".join(t.split()[: (n + 4) * part // 100]) + " " + prose(rng, 500, 10**6), "en", "s") for n, t in items for part in (78, 82, 100)]
    got = contamination.contained_items(frame(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(n + part, n) for n, _ in items for part in (82, 100)}
