"""What the operators leave on disk, and how seeds are counted."""

import os
import random

import numpy as np
from pyspark.sql import functions as F
from test_small import frame

from quillstream.llm import common, passages


def test_durable_leaves_no_shuffle_files(spark):
    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = files()
    out = common.durable(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
    assert out.count() == 7
    left = {f for f in files() - before if f.endswith(".data")}
    assert len(left) <= 1  # that of count() itself


def test_op1_seeds_seen_twice(spark, monkeypatch):
    """Counting by ranges of hashes finds the seeds of two documents or more, also where a task passes its seeds on in several parts."""
    monkeypatch.setattr(passages, "HELD_SEEDS", 100)
    rng = random.Random(3)
    shared = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(4)]
    texts = [" ".join([f"w{rng.randrange(5000)}" for _ in range(80)] + rng.choice(shared)) for _ in range(40)] + ["a b c d e " * 9]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).select("doc_id", "text").repartition(3)
    got = docs.mapInArrow(passages._seed_ranges, "range int, seeds binary").repartition("range").sortWithinPartitions("range").mapInArrow(passages._seen_twice, "seed long")
    count = {}
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        for h in set(passages._chosen(passages.Words(data, np.array([0, len(data)])), 1)[0].view(np.int64).tolist()):
            count[h] = count.get(h, 0) + 1
    assert sorted(r.seed for r in got.collect()) == sorted(h for h, n in count.items() if n > 1)
