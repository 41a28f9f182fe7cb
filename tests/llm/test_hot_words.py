"""Lines of words that a large corpus holds often."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_small import frame

from quillstream.llm import line_dedup


def watched(monkeypatch):
    """The rows of all tables that ``durable`` writes, by name."""
    made, durable = [], line_dedup.durable

    def write(df, name):
        out = durable(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "durable", write)
    return made


def test_op2_hot_words_fetch_no_words_of_other_lines(spark, monkeypatch):
    """Lines that share hot words alone: the words of all 200 were fetched, and went with each of their hot words through a join."""
    monkeypatch.setattr(line_dedup, "HOT", 8)
    made, draw, pool = watched(monkeypatch), random.Random(5), [f"pool{k}" for k in range(60)]
    lines = [" ".join(draw.sample(pool, 14)) for _ in range(200)] + ["a line of its own that comes twice over"]
    rows = [(i, line, "en", "s") for i, line in enumerate(lines)] + [(900, "a line of its own that comes twice", "en", "s")]
    assert [(r.doc_id, r.kept_doc_id) for r in line_dedup.repeated_lines(frame(spark, rows)).collect()] == [(900, 200)]
    assert dict(made)["hot-words"] > 20 and sum(n for name, n in made if name == "pair-lines") < 20


def test_pipeline_stage_of_lines_fetches_no_words_of_other_lines(spark, monkeypatch):
    """The same in stage 2 of the pipeline, which keeps all documents."""
    monkeypatch.setattr(line_dedup, "HOT", 8)
    made, draw, pool = watched(monkeypatch), random.Random(6), [f"pool{k}" for k in range(60)]
    rows = [(i, " ".join(draw.sample(pool, 14)), "en", "s") for i in range(200)]
    docs = frame(spark, [*rows, (900, rows[7][1] + "\nkept", "en", "s")])
    cut = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert cut == {r[0]: r[1] for r in rows} | {900: "kept"}
    assert dict(made)["hot-words"] > 20 and sum(n for name, n in made if name == "pair-lines") < 20


@pytest.mark.parametrize("hot, large, block", [(512, 1 << 16, 4096), (4, 1 << 16, 3), (2, 6, 3)])
def test_op2_lines_as_by_force(spark, monkeypatch, hot, large, block):
    """All sizes and all kinds of hot words: a line goes if and only if an earlier one is similar, and the one kept is."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "LARGE", large)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    draw, pool, lines = random.Random(11), [f"w{k}" for k in range(150)], []
    for _ in range(60):
        base = draw.sample(pool, draw.choice([1, 2, 4, 5, 8, 9, 13, 20, 40]))
        for _ in range(draw.choice([1, 2, 6])):
            words = [w for w in base if draw.random() > 0.08] + draw.sample(pool, draw.choice([0, 0, 1, 2]))
            lines.append(" ".join(draw.sample(words, len(words))))
    draw.shuffle(lines)
    sets = [frozenset(line.split()) for line in lines]
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    want = {i for i, s in enumerate(sets) if s and any(alike(s, sets[j]) for j in range(i))}
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.repeated_lines(frame(spark, [(i, t, "en", "s") for i, t in enumerate(lines)])).collect()}
    assert set(got) == want and all(j < i and alike(sets[i], sets[j]) for i, j in got.items())


def test_op2_join_shuffles_entries_once(spark):
    """Both sides of the join of lines read one shuffle, and nothing is shuffled behind it."""
    entries = spark.range(4000).select((F.col("id") % 50).cast("int").alias("token"), F.col("id").alias("row"), F.lit(0).alias("line_no"), F.lit(20).alias("n"), F.lit(18).alias("left"), F.struct(F.col("id").alias("low"), F.col("id").alias("high")).alias("bits"))
    with line_dedup._dealt_by_token(spark):
        met = line_dedup._met_by_size(["row", "line_no"], entries.repartition("token").withColumn("done", F.lit(False)))
        met.collect()
        final = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("- Exchange hashpartitioning") == 1 and "ReusedExchange" in final
