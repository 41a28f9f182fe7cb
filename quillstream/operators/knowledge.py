"""A knowledge base on a folder of Parquet tables: ingest, list, remove, re-index and ask.

The embedder is a callable that the caller supplies (a batch of texts in, vectors out); without it the base works on
words alone. Answers are passages, or written by a callable that the caller supplies (a batch of prompts in, texts out).
Answering: O-RUL-9 to O-RUL-11, O-PRJ-7, O-JOIN-8, O-SRC-17, O-SNK-14.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import kept
from ..sources import readers
from . import answers, chunking, privacy, search
from .lexical_index import LexicalIndex

BATCH = 32
_DOCS = "doc_id long, title string, kind string, filename string, bytes long, text string"


@dataclass
class KnowledgeBase:
    spark: SparkSession
    folder: str
    embed: Callable[[list[str]], list[list[float]]] | None = None
    generate: Callable[[list[str]], list[str | None]] | None = None

    def _table(self, name: str, schema: str) -> DataFrame:
        """The newest version of a table: versions are folders of their own, so a reader never sees a half-written one."""
        versions = self.spark.read.schema(schema)
        newest = self._version(name)
        return versions.parquet(f"{self.folder}/{name}/{newest}") if newest else self.spark.createDataFrame([], schema)

    def _version(self, name: str) -> str | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(path) else []
        return max(done, default=None)

    def _write(self, name: str, rows: DataFrame) -> None:
        number = int((self._version(name) or "v0").split("-")[0][1:]) + 1
        rows.write.parquet(f"{self.folder}/{name}/v{number:09d}-{uuid.uuid4().hex[:8]}")

    def docs(self) -> DataFrame:
        return self._table("docs", _DOCS)

    def chunks(self) -> DataFrame:
        return self._table("chunks", "id string, doc_id long, idx int, headings array<string>, body string, title string, embedding array<float>")

    def ingest(self, path: str) -> DataFrame:
        """Read files, replace earlier versions of the same name and kind, and report a row per file."""
        files = readers.ingest(self.spark, path)
        new = files.where("error is null").select(F.xxhash64("filename", "kind").alias("doc_id"), "title", "kind", "filename", "bytes", "text")
        self._write("docs", self.docs().join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new))
        self.reindex(new.select("doc_id"))
        return files.select("filename", "kind", "bytes", "error")

    def remove(self, doc_ids: DataFrame) -> None:
        """Take documents out, and their passages with them; no other document is chunked again."""
        self._write("docs", self.docs().join(doc_ids.select("doc_id"), "doc_id", "left_anti"))
        gone = self.chunks().join(doc_ids.select("doc_id"), "doc_id", "left_semi").select(F.xxhash64("id").alias("id"))
        self.index().remove(gone, "id")
        self._write("chunks", self.chunks().join(doc_ids.select("doc_id"), "doc_id", "left_anti").select(*self.chunks().columns))

    def reindex(self, doc_ids: DataFrame | None = None) -> None:
        """Chunk the given documents, or all; vectors of passages that are known are kept, the others are made in batches."""
        docs, old = self.docs(), self.chunks()
        rest = old.limit(0)
        if doc_ids is not None:
            docs, rest = docs.join(doc_ids.distinct(), "doc_id", "left_semi"), old.join(doc_ids.distinct(), "doc_id", "left_anti").select(*old.columns)
        made = chunking.chunk(docs).join(docs.select("doc_id", "title"), "doc_id")
        known = old.where("embedding is not null").select("id", "body", "embedding")
        rows = made.join(known, ["id", "body"], "left").select("id", "doc_id", "idx", "headings", "body", "title", "embedding")
        rows = rows.unionByName(rest)
        if self.embed:
            rows = rows.where("embedding is not null").unionByName(rows.where("embedding is null").mapInPandas(self._embedder(), rows.schema))
        self._write("chunks", rows)
        ours = self._passages()
        if doc_ids is not None:
            old, ours = old.join(doc_ids.distinct(), "doc_id", "left_semi"), ours.join(doc_ids.distinct(), "doc_id", "left_semi")
        self.index().remove(old.select(F.xxhash64("id").alias("id")).join(ours.select("id"), "id", "left_anti"), "id")
        self.index().add(ours, "id")

    def index(self) -> LexicalIndex:
        """Stems of all passages; an upload adds a segment of its own."""
        return LexicalIndex(self.spark, f"{self.folder}/index", text.tokenize)

    def _embedder(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        embed = self.embed

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in range(0, len(frame), BATCH):
                    part = frame.iloc[i : i + BATCH].copy()
                    try:
                        vectors: list = embed(part["body"].tolist())
                    except Exception:  # these passages stay searchable by words, and pending
                        vectors = [None] * len(part)
                    part["embedding"] = vectors if len(vectors) == len(part) else [None] * len(part)
                    yield part

        return run

    def status(self) -> DataFrame:
        return self.chunks().agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.count("embedding").alias("embedded"), (F.count("*") - F.count("embedding")).alias("pending"))

    def _asked_vectors(self, questions: DataFrame) -> DataFrame:
        """``question, q``; questions that the embedder fails on have none, and are answered by words alone."""
        embed = self.embed

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in range(0, len(frame), BATCH):
                    part = frame.iloc[i : i + BATCH]
                    try:
                        vectors: list = embed(part["text"].tolist())
                    except Exception:
                        continue
                    if len(vectors) == len(part):
                        yield pd.DataFrame({"question": part["item_id"], "q": vectors})

        return questions.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "question long, q array<float>")

    def search(self, questions: DataFrame, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Ranked hits (question, id, doc_id, score, rank) and ``question, top, coverage, confidence`` for questions (item_id, text).

        Words are stems; where there is an embedder, passages with vectors are scored by both. A document fills three quarters of the hits at most.
        ``owners`` (doc_id, owner) names the plan that a document belongs to: for a question with another ``active`` plan it counts less.
        """
        passages = self._passages()
        index = self.index()
        lexical = index.scores(questions, as_key="id")
        if self.embed:
            vectors = passages.where("embedding is not null").select("id", "embedding")
            near = search.dense(self._asked_vectors(questions), vectors, key="id")
            scored = search.blended(lexical, near, vectors.select("id"), key="id")
        else:
            scored = lexical.withColumnRenamed("lexical", "score")
        scored = scored.join(passages.select("id", "doc_id"), "id")
        if owners is not None and "active" in questions.columns:
            scored = search.penalised(scored.join(questions.select(F.col("item_id").alias("question"), "active"), "question"), owners, F.col("active"))
        hits = kept(search.diversified(scored.select("question", "id", "doc_id", "score"), "doc_id", key="id"), "hits")
        return hits, search.confidence(hits, questions, index.held(hits.where("rank <= 3"), "id"), key="id", split=text.tokenize)

    def _passages(self) -> DataFrame:
        return self.chunks().select(F.xxhash64("id").alias("id"), "doc_id", F.concat_ws("\n", "title", F.array_join("headings", "\n"), "body").alias("text"), "title", "headings", "body", "embedding")

    def ask(self, questions: DataFrame, owners: DataFrame | None = None) -> DataFrame:
        """``question, confidence, mode, answer`` for a batch of questions (item_id, text, and if known previous, active, record).

        A question that misses, or a bare follow-up of two words at most that is not sure, is asked again together with the one before
        it; the second result is taken where it is a hit and the surer one (O-RUL-10). Questions after other people's records are declined.
        Where there is a ``generate``, the passages that fit the budget, and the asker's own ``record``, become its prompt: an answer that
        says there is none counts as none, a failed call leaves the best passage. With a record, no missed search ends the question.
        """
        optional = lambda c: F.col(c) if c in questions.columns else F.lit(None).cast("string")
        asked = questions.select("item_id", "text", *[optional(c).alias(c) for c in ("previous", "active", "record")])
        hits, sure = self.search(asked, owners)
        met = sure.select("question", "confidence")
        if "previous" in questions.columns:
            wider = asked.where(F.trim(F.coalesce("previous", F.lit(""))) != "").select("item_id", F.concat_ws(" ", "previous", "text").alias("text"), "active")
            more, surer = self.search(wider, owners)
            bare = asked.select(F.col("item_id").alias("question"), (F.size(text.tokenize(F.col("text"))) <= 2).alias("_bare"))
            met = met.join(surer.select("question", F.col("confidence").alias("_c")), "question", "left").join(bare, "question", "left")
            taken = F.coalesce(answers.retried(F.col("confidence"), F.col("_c"), F.col("_bare")), F.lit(False))
            met = kept(met.select("question", F.when(taken, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"), taken.alias("wider")), "sure")
            hits = hits.join(met.where("not wider"), "question", "left_semi").unionByName(more.join(met.where("wider"), "question", "left_semi"))
        shown = self._passages().select("id", answers.label(F.col("title"), F.col("headings")).alias("label"), "body")
        best = hits.where("rank = 1").select("question", "id").join(shown, "id").select("question", "label", "body")
        own = F.trim(F.coalesce("record", F.lit(""))) != ""
        declined = F.size(privacy.decline_reasons(F.col("text"))) > 0
        said = asked.select(F.col("item_id").alias("question"), "text", "record", own.alias("own"), declined.alias("declined"))
        met = said.join(met.select("question", "confidence"), "question").join(best, "question", "left")
        met = met.withColumn("open", ~F.col("declined") & (F.col("own") | (F.col("confidence") >= answers.MISS)))
        met = self._written(met, hits, shown) if self.generate else met.withColumn("written", F.lit(None).cast("string"))
        refused = F.coalesce(answers.refusal(F.col("written")), F.lit(False))
        mode = F.when(F.col("declined"), "declined").when(~F.col("open") | refused, "none").when(F.col("written").isNotNull(), "generated").when(F.col("body").isNotNull(), "extractive").otherwise("none")
        met = met.withColumn("mode", mode)
        answer = F.when(F.col("mode") == "generated", text.strip_citations(F.col("written"))).when(F.col("mode") == "extractive", answers.extractive(F.col("confidence"), F.col("label"), F.col("body")))
        return met.select("question", "confidence", "mode", answer.alias("answer"))

    def _written(self, met: DataFrame, hits: DataFrame, shown: DataFrame) -> DataFrame:
        """``met`` with ``written``, what ``generate`` makes of each open question's prompt; null where it fails or gives nothing."""
        generate = self.generate
        ranked = hits.select("question", "id", "rank").join(shown, "id").join(met.where("open").select("question"), "question", "left_semi")
        fit = answers.within_budget(ranked, "question", "body", F.length("label"))
        # As many entries at most as a question has hits, within the budget of characters.
        context = fit.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("\n", "label", "body").alias("p")))).alias("ps"))
        prompts = met.where("open").select("question", "text", "record").join(context, "question", "left")
        passages = F.array_join(F.transform("ps", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["p"])), "\n\n")
        prompts = prompts.select("question", F.concat_ws("\n\n", passages, F.when(F.trim("record") != "", F.concat(F.lit("Record:\n"), "record")), F.concat(F.lit("Question: "), "text")).alias("prompt"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in range(0, len(frame), BATCH):
                    part = frame.iloc[i : i + BATCH]
                    try:
                        texts: list = generate(part["prompt"].tolist())
                    except Exception:  # the best passage takes its place
                        continue
                    if len(texts) == len(part):
                        yield pd.DataFrame({"question": part["question"], "written": texts})

        written = prompts.mapInPandas(run, f"question {prompts.schema['question'].dataType.simpleString()}, written string")
        return met.join(written, "question", "left")

    def import_snapshot(self, path: str) -> DataFrame:
        """Take over a JSON snapshot of an earlier store, once: a base that holds passages stays as it is (O-SRC-17).

        Passages without id or text and documents without id are left out, empty vectors count as none, and term counts are made anew from
        the texts. A malformed file leaves the base empty. Returns ``docs, chunks, embedded``: what was taken.
        """
        none = self.spark.createDataFrame([(0, 0, 0)], "docs long, chunks long, embedded long")
        if not self.chunks().isEmpty():
            return none
        docs, chunks = readers.snapshot(self.spark, path, readers.SNAPSHOT)
        vector = F.when(F.size("embedding") > 0, F.col("embedding"))
        chunks = chunks.where("id is not null and text is not null").select("id", F.xxhash64("docId").alias("doc_id"), F.col("index").alias("idx"), F.coalesce("headings", F.array().cast("array<string>")).alias("headings"), F.col("text").alias("body"), vector.alias("embedding"))
        chunks = kept(chunks, "chunks")
        if chunks.isEmpty():
            return none
        whole = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "id", "body"))), lambda x: x["body"]), "\n\n").alias("text"))
        docs = docs.where("id is not null").select(F.xxhash64("id").alias("doc_id"), "title", "kind", "filename", "bytes").join(whole, "doc_id", "left")
        self._write("docs", docs.select("doc_id", "title", "kind", "filename", "bytes", "text"))
        self._write("chunks", chunks.join(self.docs().select("doc_id", "title"), "doc_id", "left").select("id", "doc_id", "idx", "headings", "body", "title", "embedding"))
        self.index().add(self._passages(), "id")
        return self.chunks().agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded")).crossJoin(self.docs().agg(F.count("*").alias("docs"))).select("docs", "chunks", "embedded")
