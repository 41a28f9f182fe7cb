"""The persisted index against search over the texts, through uploads, replacements, removals and compaction."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import search
from quillstream.operators.lexical_index import LexicalIndex

TOPICS = ["leave carry encash annual", "payout slab target rating", "ticket route owner queue", "laptop screen repair vendor"]


def _docs(spark, ids, extra=""):
    rows = [(i, " ".join(f"{w} " * (1 + (i * (j + 3)) % 5) for j, w in enumerate(TOPICS[i % 4].split())) + f" note{i % 7} {extra}" + " filler" * (i % 11)) for i in ids]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _questions(spark):
    return spark.createDataFrame([(1, "carry annual leave note3"), (2, "slab target"), (3, "unknown words"), (4, ""), (5, "repair filler note1 vendor"), (6, None)], "item_id long, text string")


def _rows(df):
    return sorted((r.question, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())


def _same(index, questions, docs, k=5):
    want = _rows(search.ranked(search.bm25(questions, docs).withColumnRenamed("lexical", "score"), k))
    assert want and _rows(index.topk(questions, k, prune=False)) == want
    assert _rows(index.topk(questions, k, prune=True)) == want


def test_index_follows_uploads_and_removals(spark, tmp_path):
    index, asked = LexicalIndex(spark, str(tmp_path)), _questions(spark)
    assert index.topk(asked).count() == 0 and index.docs().count() == 0  # an empty index answers
    docs = _docs(spark, range(300))
    index.add(docs)
    _same(index, asked, docs)
    changed = _docs(spark, range(280, 320), extra="slab leave")
    index.add(changed)
    docs = docs.where("doc_id < 280").unionByName(changed)
    _same(index, asked, docs)
    assert index._commit_row().n == 320
    index.remove(docs.where("doc_id % 5 = 0"))
    docs = docs.where("doc_id % 5 <> 0")
    _same(index, asked, docs)
    files = {r[0] for r in index._read("postings", "term string").select(F.input_file_name()).distinct().collect()}
    index.compact()
    _same(index, asked, docs)
    assert files <= {r[0] for r in index._read("postings", "term string").select(F.input_file_name()).distinct().collect()}  # nothing in force before was rewritten


def test_upload_touches_only_its_terms(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path))
    index.add(_docs(spark, range(100)))
    index.add(spark.createDataFrame([(1000, "brandnew word"), (None, "no key"), (1001, None)], "doc_id long, text string"))
    newest = index._commit_row().segments[-1]
    assert sorted(r.term for r in index._read("postings", "term string, segment string").where(F.col("segment") == newest).collect()) == ["brandnew", "word"]
    assert index._commit_row().n == 102


def test_bounds_leave_ranges_out(spark, tmp_path):
    """Alike passages stand together, so a question about one topic leaves most ranges out and its ranks stay exact."""
    index = LexicalIndex(spark, str(tmp_path))
    docs = _docs(spark, range(2000))
    index.add(docs)
    asked = _questions(spark).where("item_id = 5")
    _, able, every = index.pruned(asked, 5)
    assert able.count() < every.count() / 2
    _same(index, asked, docs)


@pytest.mark.parametrize("name", ["kb_bm25_topk", "kb_coverage_confidence"])
def test_index_is_made_once(spark, name):
    from quillstream.plans import catalogue, searching

    folder = "/root/testdata/sf0.001"
    before = searching.index_of(spark, folder)
    catalogue.QUERIES[name](spark, folder).count()
    assert searching.index_of(spark, folder).folder == before.folder and before.version() == 1


def test_scan_hands_on_few_rows_and_loses_no_rank(spark, tmp_path, monkeypatch):
    """Copies tie, groups have firsts of their own, and what leaves the tasks does not grow with the number of passages."""
    from pyspark.sql import Window

    from quillstream.operators import lexical_index

    docs = _docs(spark, range(600)).unionByName(_docs(spark, range(0, 120, 3)).withColumn("doc_id", F.col("doc_id") + 1000))
    docs = docs.unionByName(spark.createDataFrame([(5000 + i, "carry slab") for i in range(50)], docs.schema))
    asked, groups = _questions(spark), docs.where("doc_id % 3 < 2").select("doc_id", F.concat(F.lit("g"), (F.col("doc_id") % 3).cast("string")).alias("group"))
    index = LexicalIndex(spark, str(tmp_path))
    index.add(docs)
    every = search.bm25(asked, docs).join(groups, "doc_id", "left")
    place = F.row_number().over(Window.partitionBy("question", "group").orderBy(F.desc("lexical"), "doc_id"))
    want = every.withColumn("p", place).where("p <= 4").select("question", "doc_id", "group", F.round("lexical", 8).alias("s"))
    best = index.best(asked, 4, groups=groups, scales=[[(38, 100)], [(4, 10)]])
    found = best.withColumn("p", place).where("p <= 4").select("question", "doc_id", "group", F.round("lexical", 8).alias("s"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert index.best(asked, 4).count() < every.count() / 2
    pairs = docs.where("doc_id % 50 = 0").select("doc_id").crossJoin(asked.select(F.col("item_id").alias("question")))
    some = lambda df: sorted((r.question, r.doc_id, round(r.lexical, 9)) for r in df.select("question", "doc_id", "lexical").collect())
    assert some(index.scores_of(pairs, asked)) == some(every.where("doc_id % 50 = 0"))
    ranks = _rows(search.ranked(search.bm25(asked, docs).withColumnRenamed("lexical", "score"), 5))
    for few, most, cells in ((0, 0, 4_000_000), (10**9, 10**6, 64), (10**9, 10**6, 4_000_000)):  # blocks, a scan that settles often, a scan
        for name, value in (("FEW", few), ("MOST_WEIGHTS", most), ("CELLS", cells)):
            monkeypatch.setattr(lexical_index, name, value)
        assert _rows(index.topk(asked, 5)) == ranks
