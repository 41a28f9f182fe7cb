"""A persisted inverted index for BM25: segments of posting blocks, pruned exact top-k, uploads that touch only their own terms.

Operators: O-AGG-9 to O-AGG-11, O-JOIN-6, O-SRC-14 to O-SRC-16, O-SRT-7. Tables under one folder, each upload a segment of each:

* ``docs``: ``key, len, bag`` with the terms of a passage and how often it holds them, the forward side.
* ``postings``: one row for each term and range of passages: ``term, range, n, max_tf, min_len, entries``, in folders by
  a hash of the term and sorted by term, so that a question reads the folders of its terms and of these the row groups that hold them.
* ``gone``: ``key, owner, len, term``: passages of earlier segments that the upload replaces or removes, a row for each of their terms.
* ``commits``: one row for each version: the segments in force and the counts of passages and terms. Readers see committed segments only.

Passages are ordered by their most frequent term and their length and cut into ranges of ``RANGE``, the same for all terms, so that a range
holds passages that are alike. The greatest tf and the least length bound what a block can add to a score, whatever the corpus statistics have become since. The sum of
a question's bounds over a range bounds every passage in it. Top-k scores the ``FIRST`` most promising ranges of each question, takes
the k-th score found there as threshold and then scores the ranges that could still pass it; the rest is never decoded. Frequencies come
from the block counts less what is gone, lengths from the commits: nothing is counted anew over the corpus.

A batch whose terms are held by a large share of all passages is answered by a scan of ``docs`` instead (``best``): each task scores its
passages against all questions and hands on the first ``k`` of each question and group, so neither memory nor shuffles grow with the
number of (question, passage) pairs. Tables are made in tasks of ``TASK_CHARS`` characters, however many there are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import kept
from . import search

RANGE, FOLDERS, FIRST = 16, 16, 16
PRUNE_FROM = 500_000_000  # terms in the index, repeats included, from which bounds are worth the passes they cost
TASK_CHARS, SLICE, CELLS = 16_000_000, 1_000, 4_000_000  # characters to a task; passages and scores held at a time
MOST_WEIGHTS, FEW = 500_000, 8  # (question, term) rows that go to every task; what the blocks' way is worth beside a scan
_DOCS = "key long, len int, bag array<struct<term: string, tf: int>>, range long, segment string"
_POSTINGS = "term string, range long, n int, max_tf int, min_len int, entries array<struct<key: long, tf: int, len: int>>, segment string, folder int"
_GONE = "key long, owner string, len int, term string, segment string"
_COMMITS = "version int, segments array<string>, n long, total long"


def folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def part(tf: Column, length: Column, n: Column, total: Column) -> Column:
    """What a term with weight 1 adds for this tf and length."""
    norm = 1 - search.B + search.B * (length / F.greatest(F.lit(1.0), total / n))
    return tf * (search.K1 + 1) / (tf + search.K1 * norm)


def saturated(raw: Column) -> Column:
    return F.round(raw / (raw + search.SATURATION), 9)


def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, len, bag) of passages (key, terms): each term once, with how often it stands there."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            lengths = pa.compute.fill_null(pa.compute.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = part.column(1).flatten().dictionary_encode()
            width = max(1, len(terms.dictionary))
            held, tf = np.unique(np.repeat(np.arange(part.num_rows), lengths) * width + terms.indices.to_numpy(), return_counts=True)
            offsets = np.searchsorted(held, np.arange(part.num_rows + 1) * width)
            bag = pa.StructArray.from_arrays([terms.dictionary.take(pa.array(held % width)), pa.array(tf, pa.int32())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), bag)], names=["key", "len", "bag"])


def first_of(weights: list[tuple[int, str, float]], k: int, scales: list[list[tuple[int, int]]], average: float):
    """(question, key, lexical, group) of the passages (key, len, bag, group) of a task: the first ``k`` of each question and group.

    ``scales`` names further orders, each a list of fractions that a score is multiplied by and rounded; the first ``k`` by each of
    them stay. Scores are whole billionths while they are compared, so that ties are ties; keys decide them.
    """
    vocabulary = sorted({t for _, t, _ in weights})
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = np.array(sorted({q for q, _, _ in weights}), np.int64)
    order = sorted((place[t], q, w) for q, t, w in weights)
    owner, weight = np.searchsorted(asked, np.array([q for _, q, _ in order], np.int64)), np.array([w for _, _, w in order], np.float64)
    starts = np.searchsorted(np.array([t for t, _, _ in order], np.int64), np.arange(len(vocabulary) + 1))
    many, least = len(asked), max(1, min(SLICE, CELLS // max(1, len(asked))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, groups = pa.array(vocabulary, pa.string()), {}
        rows = np.empty((0, 4), np.int64)  # question, group, score, key
        floors: dict = {"low": np.zeros((many, 0), np.int64)}

        def settled(rows: np.ndarray) -> np.ndarray:
            stay = np.zeros(len(rows), bool)
            for scale in [[], *scales]:
                score = rows[:, 2]
                for up, down in scale:
                    score = (2 * score * up + down) // (2 * down)
                at = np.lexsort((rows[:, 3], -score, rows[:, 1], rows[:, 0]))
                new = np.r_[True, (rows[at][1:, :2] != rows[at][:-1, :2]).any(axis=1)]
                rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                stay[at[rank < k]] = True
                if not scale:
                    low, last = np.zeros((many, len(groups)), np.int64), at[rank == k - 1]
                    low[rows[last, 0], rows[last, 1]] = rows[last, 2]
                    floors["low"] = low
            return rows[stay]

        for batch in batches:
            for i in range(0, batch.num_rows, least):
                part = batch.slice(i, least)
                bags = part.column(2)
                doc = np.repeat(np.arange(part.num_rows), pa.compute.fill_null(pa.compute.list_value_length(bags), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                held = bags.flatten()
                code = pa.compute.fill_null(pa.compute.index_in(held.field("term"), value_set=known), -1).to_numpy()
                met = np.flatnonzero(code >= 0)
                doc, code, tf = doc[met], code[met], held.field("tf").to_numpy()[met].astype(np.float64)
                norm = 1 - search.B + search.B * (part.column(1).to_numpy()[doc] / average)
                x = tf * (search.K1 + 1) / (tf + search.K1 * norm)
                times = starts[code + 1] - starts[code]
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[code], times)
                raw = np.bincount(np.repeat(doc, times) * many + owner[at], np.repeat(x, times) * weight[at], part.num_rows * many).reshape(part.num_rows, many)
                score = np.rint(raw / (raw + search.SATURATION) * 1e9).astype(np.int64)
                group = np.array([groups.setdefault(g, len(groups)) for g in part.column(3).to_pylist()], np.int64)
                low = floors["low"]
                if low.shape[1] < len(groups):
                    low = floors["low"] = np.pad(low, ((0, 0), (0, len(groups) - low.shape[1])))
                d, q = np.nonzero((score > 0) & (score >= low[:, group].T - 16))  # 16: what the scales may round away
                rows = np.r_[rows, np.c_[q, group[d], score[d, q], part.column(0).to_numpy()[d]]]
                if len(rows) > CELLS // 16:
                    rows = settled(rows)
        if len(rows):
            rows, names = settled(rows), list(groups)
            columns = [pa.array(asked[rows[:, 0]]), pa.array(rows[:, 3]), pa.array(rows[:, 2] / 1e9), pa.array([names[g] for g in rows[:, 1]], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["question", "key", "lexical", "group"])

    return run


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, range, n, max_tf, min_len, entries) of passages (range, key, len, bag)."""
    for batch in batches:
        ranges, keys, lengths = (batch.column(i).to_numpy() for i in range(3))
        bags = batch.column(3)
        doc = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(bags).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(doc):
            continue
        held = bags.flatten()
        terms = held.field("term").dictionary_encode()
        codes, tf = terms.indices.to_numpy(), held.field("tf").to_numpy()
        order = np.lexsort((doc, ranges[doc], codes))
        codes, tf, doc = codes[order], tf[order], doc[order]
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (ranges[doc][1:] != ranges[doc][:-1])])
        ends = np.r_[starts[1:], len(doc)]
        entries = pa.StructArray.from_arrays([pa.array(keys[doc], pa.int64()), pa.array(tf, pa.int32()), pa.array(lengths[doc], pa.int32())], ["key", "tf", "len"])
        columns = [
            terms.dictionary.take(pa.array(codes[starts])), pa.array(ranges[doc][starts], pa.int64()), pa.array(ends - starts, pa.int32()), pa.array(np.maximum.reduceat(tf, starts), pa.int32()),
            pa.array(np.minimum.reduceat(lengths[doc], starts), pa.int32()), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(doc)], pa.int32()), entries),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "range", "n", "max_tf", "min_len", "entries"])


@dataclass
class LexicalIndex:
    spark: SparkSession
    folder: str
    split: Callable[[Column], Column] = text.terms

    # ---- versions ----

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _commit_row(self):
        return self._read("commits", _COMMITS).orderBy(F.desc("version")).first()

    def version(self) -> int:
        row = self._commit_row()
        return row.version if row else 0

    def _live(self, name: str, schema: str, segments: list[str]) -> DataFrame:
        return self._read(name, schema).where(F.col("segment").isin(segments)) if segments else self.spark.createDataFrame([], schema)

    def docs(self, state=None) -> DataFrame:
        """``key, len, bag, segment`` of the passages in force."""
        state = state or self._commit_row()
        segments = state.segments if state else []
        if len(segments) == 1:  # nothing went since
            return self._live("docs", _DOCS, segments)
        gone = self._live("gone", _GONE, segments).select("key", F.col("owner").alias("segment")).distinct()
        return self._live("docs", _DOCS, segments).join(gone, ["key", "segment"], "left_anti")

    # ---- uploads ----

    def add(self, passages: DataFrame, key: str = "doc_id", body: str = "text") -> None:
        """Index passages; those whose key is known are replaced. A key given twice is indexed by its greatest text; null keys are left out."""
        rows = passages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(body), F.lit("")).alias("body")).where("key is not null")
        tasks = self._tasks(rows.agg(F.sum(F.length("body"))).first()[0] or 0)
        rows = rows.repartition(tasks, "key").groupBy("key").agg(F.max("body").alias("body"))
        docs = rows.select("key", self.split(F.col("body")).alias("terms")).mapInArrow(bagged, _DOCS.removesuffix(", range long, segment string"))
        self._upload(docs, None, tasks=tasks)

    def _tasks(self, chars: int) -> int:
        """Tasks for so many characters: ``TASK_CHARS`` each at most, and the cores busy where there is enough to do."""
        return max(1, math.ceil(chars / TASK_CHARS), min(self.spark.sparkContext.defaultParallelism, chars * 8 // TASK_CHARS))

    def remove(self, keys: DataFrame, key: str = "doc_id") -> None:
        self._upload(None, keys.select(F.col(key).cast("long").alias("key")).distinct())

    def compact(self) -> None:
        """One segment out of all; readers of the old version keep its files."""
        state = self._commit_row()
        if state:
            self._upload(self.docs(state).select("key", "len", "bag"), None, fresh=True, tasks=self._tasks(6 * state.total))

    def _upload(self, docs: DataFrame | None, keys: DataFrame | None, fresh: bool = False, tasks: int = 1) -> None:
        state, segment = self._commit_row(), uuid.uuid4().hex
        segments, n, total = (list(state.segments), state.n, state.total) if state and not fresh else ([], 0, 0)
        version = state.version + 1 if state else 1
        if docs is not None:
            main = F.array_max(F.transform("bag", lambda b: F.struct(b["tf"], b["term"])))["term"]
            near = docs.withColumn("main", main).repartitionByRange(tasks, "main", "len", "key").sortWithinPartitions("main", "len", "key")
            near.select("key", "len", "bag", F.floor(F.monotonically_increasing_id() / RANGE).alias("range")).write.parquet(f"{self.folder}/docs/segment={segment}")
            docs = self.spark.read.schema(_DOCS.removesuffix(", segment string")).parquet(f"{self.folder}/docs/segment={segment}")
            keys = docs.select("key")
            size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
            n, total = n + size.n, total + size.total
            self._post(segment)
        if segments:
            old = self.docs(state).join(keys, "key", "left_semi").select("key", F.col("segment").alias("owner"), "len", F.explode_outer("bag.term").alias("term"))
            path = f"{self.folder}/gone/segment={segment}"
            old.write.parquet(path)
            out = self.spark.read.schema("key long, owner string, len int, term string").parquet(path).select("key", "owner", "len").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
            n, total = n - out.n, total - out.total
        commit = self.spark.createDataFrame([(version, [*segments, segment], n, total)], _COMMITS)
        commit.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _post(self, segment: str) -> None:
        """Write the blocks of passages that lie in the order of their ranges: each task makes those of its own, nothing is shuffled.

        A session of its own reads few files in a task, whatever the table's size. Where a range begins in one batch and ends in the next, a term has two blocks for it; their counts and bounds add up.
        """
        spark = self.spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_CHARS))
        docs = spark.read.schema(_DOCS.removesuffix(", segment string")).parquet(f"{self.folder}/docs/segment={segment}")
        blocks = docs.select("range", "key", "len", "bag").mapInArrow(posted, _POSTINGS.removesuffix(", segment string, folder int"))
        blocks.withColumn("folder", folder_of(F.col("term"))).sortWithinPartitions("folder", "term", "range").write.partitionBy("folder").parquet(f"{self.folder}/postings/segment={segment}")

    # ---- questions ----

    def _asked(self, questions: DataFrame, key: str, body: str):
        """What a batch needs: weighted terms of each question, its terms' blocks, gone passages, corpus counts."""
        state = self._commit_row()
        segments, n, total = (state.segments, state.n, state.total) if state else ([], 0, 0)
        asked = search.question_terms(questions, key, body, self.split)
        terms = asked.select("term").distinct()
        blocks = self._live("postings", _POSTINGS, segments)
        folders = [r[0] for r in terms.select(folder_of(F.col("term"))).distinct().collect()]  # at most FOLDERS numbers
        blocks = blocks.where(F.col("folder").isin(folders)).join(terms, "term", "left_semi")
        gone = self._live("gone", _GONE, segments)
        counted = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        lost = gone.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("lost"))
        df = F.col("df") - F.coalesce("lost", F.lit(0))
        n_col, total_col = F.lit(float(max(n, 1))), F.lit(float(total))
        weights = asked.join(counted, "term").join(lost, "term", "left").where(df > 0).select("question", "term", search.idf(df.cast("double"), n_col).alias("weight"), df.alias("df"))
        weights = kept(weights, "weights")  # read by every join below; Spark knows its size
        return weights, blocks, gone.select("key", F.col("owner").alias("segment")).distinct(), n_col, total_col

    def _scored(self, weights: DataFrame, blocks: DataFrame, gone: DataFrame, n: Column, total: Column, ranges: DataFrame | None = None) -> DataFrame:
        """``question, key, raw``; with ``ranges`` (question, segment, range) of these alone.

        The blocks of a range are brought together once, before questions multiply them: the sums of a question's passages are then
        made where the blocks are, and only scores leave the task.
        """
        met = blocks.repartition("segment", "range").join(weights.drop("df"), "term")
        if ranges is not None:
            met = met.join(ranges, ["question", "segment", "range"], "left_semi")
        spread = met.select("question", "segment", "range", "weight", F.explode("entries").alias("e"))
        x = F.col("weight") * part(F.col("e.tf"), F.col("e.len"), n, total)
        sums = spread.groupBy("question", "segment", "range", F.col("e.key").alias("key")).agg(F.sum(x).alias("raw"))
        return sums.join(gone, ["key", "segment"], "left_anti").select("question", "key", "raw")

    def scores(self, questions: DataFrame, key: str = "item_id", body: str = "text", as_key: str = "doc_id") -> DataFrame:
        """``question, key, lexical`` of every passage that shares a term with a question, as ``search.bm25`` gives them."""
        raw = self._scored(*self._asked(questions, key, body))
        return raw.select("question", F.col("key").alias(as_key), saturated(F.col("raw")).alias("lexical"))

    def best(self, questions: DataFrame, k: int, key: str = "item_id", body: str = "text", as_key: str = "doc_id", groups: DataFrame | None = None, scales: list[list[tuple[int, int]]] = []) -> DataFrame:
        """``question, key, lexical, group``: of ``scores``, each question's first ``k`` of every group, and more that did not fall out in their task.

        ``groups`` (key, group) puts passages into groups; the rest have none, which is a group too. Beyond ``MOST_WEIGHTS`` rows of questions
        and terms, all scores are made by joins.
        """
        asked = self._asked(questions, key, body)
        if asked[0].count() > MOST_WEIGHTS:
            every = self._scored(*asked).select("question", F.col("key").alias(as_key), saturated(F.col("raw")).alias("lexical"))
            return every.join(groups, as_key, "left") if groups is not None else every.withColumn("group", F.lit(None).cast("string"))
        return self._scanned(asked[0], k, as_key, groups, scales)

    def _scanned(self, weights: DataFrame, k: int, as_key: str, groups: DataFrame | None = None, scales: list[list[tuple[int, int]]] = []) -> DataFrame:
        state = self._commit_row()
        n, total = (state.n, state.total) if state else (0, 0)
        docs, tasks = self.docs(state).select("key", "len", "bag"), self._tasks(6 * total)
        if groups is None:
            docs = docs.withColumn("group", F.lit(None).cast("string"))
        else:
            named = groups.select(F.col(as_key).cast("long").alias("key"), F.col("group").cast("string").alias("group"))
            docs = docs.repartition(tasks, "key").join(named.repartition(tasks, "key"), "key", "left").select("key", "len", "bag", "group")
        listed = [(r.question, r.term, r.weight) for r in weights.collect()]  # MOST_WEIGHTS at most
        found = docs.mapInArrow(first_of(listed, k, scales, max(1.0, total / max(n, 1))), "question long, key long, lexical double, group string")
        return found.withColumnRenamed("key", as_key)

    def scores_of(self, pairs: DataFrame, questions: DataFrame, key: str = "item_id", body: str = "text", as_key: str = "doc_id") -> DataFrame:
        """``question, key, lexical`` of the pairs (question, key) that share a term, from the forward side."""
        weights, _, _, n, total = self._asked(questions, key, body)
        pairs = pairs.select("question", F.col(as_key).cast("long").alias("key")).distinct().join(weights.select("question").distinct(), "question", "left_semi")
        held = self.docs().join(pairs, "key").select("question", "key", "len", F.explode("bag").alias("b")).select("question", "key", "len", "b.term", "b.tf")
        x = F.col("weight") * part(F.col("tf"), F.col("len"), n, total)
        raw = held.join(weights.drop("df"), ["question", "term"]).groupBy("question", "key").agg(F.sum(x).alias("raw"))
        return raw.select("question", F.col("key").alias(as_key), saturated(F.col("raw")).alias("lexical"))

    def bounded(self, weights: DataFrame, blocks: DataFrame, n: Column, total: Column) -> DataFrame:
        """``question, segment, range, most``: what no passage of the range exceeds."""
        light = weights.drop("df").join(blocks.drop("entries"), "term")
        most = F.sum(F.col("weight") * part(F.col("max_tf"), F.col("min_len"), n, total))
        return light.groupBy("question", "segment", "range").agg(most.alias("most"))

    def pruned(self, questions: DataFrame, k: int = search.TOP_K, key: str = "item_id", body: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
        """``question, key, raw`` of a set that holds each question's top k; the ranges (question, segment, range) it comes from, and all with their bounds."""
        weights, blocks, gone, n, total = self._asked(questions, key, body)
        most = kept(self.bounded(weights, blocks, n, total), "bounds")

        def score(ranges: DataFrame) -> DataFrame:
            near = blocks.join(ranges.select("segment", "range").distinct(), ["segment", "range"], "left_semi")
            return self._scored(weights, near, gone, n, total, ranges)

        best = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("most"), "segment", "range"))
        first = kept(most.withColumn("place", best).where(F.col("place") <= FIRST).select("question", "segment", "range"), "first-ranges")
        place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("raw")))
        least = score(first).withColumn("place", place).where(F.col("place") == k).select("question", F.col("raw").alias("least"))
        # Scores are rounded after saturation: what could round to the same value stays.
        slack = F.lit(1e-8) * (F.col("least") + search.SATURATION) ** 2
        able = most.join(least, "question", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - slack)).select("question", "segment", "range")
        able = kept(able, "ranges")
        return score(able), able, most

    def topk(self, questions: DataFrame, k: int = search.TOP_K, key: str = "item_id", body: str = "text", as_key: str = "doc_id", prune: bool | None = None) -> DataFrame:
        """``question, key, score, rank``: what ranking ``scores`` gives. Where questions meet few passages, their blocks are read, and those of an index
        of ``PRUNE_FROM`` terms or more pruned; else passages are scanned. Or as ``prune`` says; rows are the same.
        """
        if prune is None:
            row, weights = self._commit_row(), self._asked(questions, key, body)[0]
            size = weights.agg(F.count("*").alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("pairs")).first()
            if row and size.pairs * FEW >= row.total and size.n <= MOST_WEIGHTS:
                return search.ranked(self._scanned(weights, k, as_key).select("question", as_key, F.col("lexical").alias("score")), k, key=as_key)
            prune = bool(row and row.total >= PRUNE_FROM)
        if not prune:
            return search.ranked(self.scores(questions, key, body, as_key).withColumnRenamed("lexical", "score"), k, key=as_key)
        raw, _, _ = self.pruned(questions, k, key, body)
        return search.ranked(raw.select("question", F.col("key").alias(as_key), saturated(F.col("raw")).alias("score")), k, key=as_key)

    def held(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """``key, term`` of the passages named, from the forward side: no text is split again."""
        return self.docs().join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias(key), F.explode("bag.term").alias("term"))
