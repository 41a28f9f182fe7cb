"""Pairs of lines that the join of line deduplication lets through."""

import random

from pyspark.sql import functions as F
from test_small import frame

from quillstream.llm import line_dedup


def test_op2_near_misses_do_not_meet(spark):
    """Lines that share their rarest words but too few of all stay apart in the join, so that a family of them makes no square of pairs."""
    rows = [(i, " ".join([f"common{k}" for k in range(8)] + [f"own{i}", f"self{i}"]), "en", "s") for i in range(60)]
    docs, name = line_dedup._rows(frame(spark, rows), "text", "doc_id")
    levels, bits = line_dedup._rarity(docs)
    told = line_dedup._described(line_dedup._lines(docs), name, levels, bits)
    entries = told.select(F.lit(1).alias("token"), *name, "n", F.col("n").alias("left"), "bits", F.lit(None).cast("array<smallint>").alias("more"))
    assert line_dedup._met(name, entries, entries).count() < 60 * 59 / 2 / 4  # all of them before the bitmaps
    assert line_dedup.repeated_lines(frame(spark, rows)).count() == 0


def test_op2_hot_words_make_similar_pairs_alone(spark, monkeypatch):
    """Long lines of a hot word that share their rarest words too: only similar ones leave the join."""
    monkeypatch.setattr(line_dedup, "HOT", 8)
    made, durable = [], line_dedup.durable
    monkeypatch.setattr(line_dedup, "durable", lambda df, name: made.append((name, durable(df, name))) or made[-1][1])
    rows = [(i, " ".join([f"common{k}" for k in range(60)] + [f"own{i}x{k}" for k in range(8)]), "en", "s") for i in range(40)]
    assert line_dedup.repeated_lines(frame(spark, rows)).count() == 0
    assert [df.count() for name, df in made if name == "rest"] == [0]


def test_op2_long_lines_of_common_words_do_not_meet(spark, monkeypatch):
    """Long lines that share their two rarest words, but too few of all: 64 bits are full for them, so 426 of 435 pairs left the join."""
    made, durable = [], line_dedup.durable
    monkeypatch.setattr(line_dedup, "durable", lambda df, name: made.append((name, durable(df, name))) or made[-1][1])
    monkeypatch.setattr(line_dedup, "release", lambda *tables: None)
    pool, draw = [f"pool{k}" for k in range(800)], random.Random(7)
    rows = [(i, " ".join(["tie", "knot"] + draw.sample(pool, 160)), "en", "s") for i in range(30)]
    often = "\n".join(f"{w} " * 40 for w in pool)  # so that the shared words are the rarest
    assert line_dedup.repeated_lines(frame(spark, rows + [(99, often, "en", "s")])).count() == 0
    assert [df.count() for name, df in made if name == "pairs"][0] < 40
