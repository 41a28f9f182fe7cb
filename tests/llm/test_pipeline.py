"""The stages of the pipeline one after the other on small tables, held against plain versions of them."""

import random

import pytest
from pyspark.sql import functions as F
from test_small import bag, edited, prose

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, documents, labels, benchmark, extra=False):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in documents], COLUMNS)
    if extra:
        docs = docs.withColumns({"label": F.lit("x"), "node": F.lit(1), "twin": F.lit(2), "item": F.lit(3), "_turn": F.lit(4)})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    good = [prose(rng, rng.randrange(60, 160)) for _ in range(60)]
    bad = [" ".join(rng.choice(["buy", "cheap", "now", "$$$", "click"]) for _ in range(80)) for _ in range(20)]
    item = prose(rng, 30, 10**6)
    line = "this very line stands in many of the documents"
    documents = [(i, f"{t}\n{line}" if i % 4 == 0 else t) for i, t in enumerate(good)]
    documents += [(100 + i, t) for i, t in enumerate(bad)]
    documents += [(200 + i, edited(rng, good[i], 1)) for i in range(1, 8)]  # near copies
    documents += [(300, f"{prose(rng, 50)} {item} {prose(rng, 50)}"), (301, None), (302, ""), (None, prose(rng, 70)), (303, good[50]), (303, prose(rng, 66))]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(20)]
    return documents, labels, [(1, item), (2, None)], line


def test_pipeline_by_stage(spark, tmp_path, corpus):
    documents, labels, benchmark, line = corpus
    folder = write(spark, f"{tmp_path}/sf", documents, labels, benchmark, extra=True)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    kept = [(r.doc_id, r.text) for r in rows["quality_classifier"]]
    assert {i for i in range(60)} <= {i for i, _ in kept} and not {100 + i for i in range(20)} & {i for i, _ in kept}
    cut = [(r.doc_id, r.text) for r in rows["line_dedup"]]
    assert len(cut) == len(kept) and sum(line in (t or "") for _, t in cut) == 1
    single = [(r.doc_id, r.text) for r in rows["near_duplicates"]]
    bags = [bag(t) for _, t in single]
    for i, a in enumerate(bags):
        for b in bags[:i]:
            assert sum((a & b).values()) < 0.8 * sum((a | b).values())
    assert set(single) <= set(cut) and (None in {i for i, _ in single}) == (None in {i for i, _ in kept})
    clean = [(r.doc_id, r.text) for r in rows["decontamination"]]
    assert set(clean) == {x for x in single if x[0] != 300}
    packed = rows["best_fit_packing"]
    assert {r.doc_id for r in packed} == {i for i, _ in clean}


def test_pipeline_runs_whole(spark, tmp_path, corpus):
    documents, labels, benchmark, _ = corpus
    folder = write(spark, f"{tmp_path}/sf", documents, labels, benchmark)
    assert corpus_pipeline.run(spark, folder).count() > 50
    empty = write(spark, f"{tmp_path}/none", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
