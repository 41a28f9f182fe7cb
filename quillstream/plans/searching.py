"""Search queries over ``documents``, ``benchmark`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import search, store
from ..operators.lexical_index import RANGE, LexicalIndex
from ..operators.vector_index import VectorIndex
from ..session import kept, load, shared_dir
from . import in_sql
from .registry import query

QUESTION = "Ingly thor hent onth the with tion er"
_POSTED = """posted as (select doc_id, term, count(*) as tf from (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from documents) where length(term) > 1 group by doc_id, term),
 lens as (select doc_id, sum(tf) as len from posted group by doc_id), n as (select (select count(*) from documents)::double as n, (select sum(len) from lens)::double as total),
 dfs as (select term, count(*) as df from posted group by term)"""


def _scored(asked: str) -> str:
    """SQL of ``scored(question, doc_id, lexical)`` for a subquery of (question, text)."""
    return f"""with {_POSTED},
 asked as (select distinct question, term from (select question, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from ({asked})) where length(term) > 1),
 raws as (select question, doc_id, sum(greatest(0.05, ln(1 + (n - df + 0.5) / (df + 0.5))) * (tf * 2.4) / (tf + 1.4 * (1 - 0.72 + 0.72 * (len / greatest(1.0, total / n))))) as raw
  from asked join posted using (term) join dfs using (term) join lens using (doc_id) cross join n group by question, doc_id),
 scored as (select question, doc_id, round(raw / (raw + 7), 9) as lexical from raws)"""


_ONE = f"select 0 as question, '{QUESTION}' as text"
_ITEMS = "select item_id as question, text from benchmark"


def one_question(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUESTION)], "item_id int, text string")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """A stated batch: all items of the benchmark."""
    return load(spark, d, "benchmark").select("item_id", "text")


def index_of(spark: SparkSession, d: str) -> LexicalIndex:
    """The index over ``documents``, made once for the files as they are and read by every later query."""
    files = spark.read.format("binaryFile").load(f"{d}/documents.parquet").select("path", "length", "modificationTime")
    tag = files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0]
    index = LexicalIndex(spark, f"{shared_dir(spark)}/lexical-b{RANGE}-{tag & (2**64 - 1):016x}")
    if index.version() == 0:
        index.add(load(spark, d, "documents"))
    return index


@query("""select doc_id, term, count(*) as tf from (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from documents) where length(term) > 1 group by doc_id, term""")
def kb_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(load(spark, d, "documents"))


@query(f"with {_POSTED} select term, df, round(greatest(0.05, ln(1 + (n - df + 0.5) / (df + 0.5))), 6) as idf from dfs cross join n")
def kb_document_frequency_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return search.term_stats(search.postings(docs), docs).select("term", "df", F.round("idf", 6).alias("idf"))


@query(_scored(_ONE) + " select doc_id, round(lexical, 6) as score, rank from (select *, row_number() over (order by lexical desc, doc_id) as rank from scored where lexical > 0.02) where rank <= 14")
def kb_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = index_of(spark, d).topk(one_question(spark))
    return hits.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_ITEMS_RANKED = _scored(_ITEMS) + " select question, doc_id, round(lexical, 6) as score, rank from (select *, row_number() over (partition by question order by lexical desc, doc_id) as rank from scored where lexical > 0.02) where rank <= 14"


@query(_ITEMS_RANKED)
def kb_multi_query_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = index_of(spark, d).topk(questions(spark, d))
    return hits.select("question", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_ITEMS_RANKED)
def kb_pruned_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same ranks by block bounds, as a large index answers."""
    hits = index_of(spark, d).topk(questions(spark, d), prune=True)
    return hits.select("question", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_COS = "list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])))"
_NEAR = f"""select question, vec_id, cosine from (select *, row_number() over (partition by question order by round(cosine, 9) desc, vec_id) as place from
 (select q.vec_id as question, e.vec_id as vec_id, {_COS} as cosine from embeddings q, embeddings e where q.vec_id % 20 = 0) where cosine >= 0.32) where place <= 200"""


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A stated set: every twentieth vector."""
    return load(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("q"))


@query(f"select question, vec_id, round(cosine, 6) as cosine from ({_NEAR})")
def kb_dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.dense(_asked_vectors(spark, d), load(spark, d, "embeddings")).select("question", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"select question, vec_id, round(case when cosine <= 0.32 then 0 else least(1.0, (cosine - 0.32) / 0.5) end, 6) as score from ({_NEAR})")
def kb_dense_rescaled(spark: SparkSession, d: str) -> DataFrame:
    near = search.dense(_asked_vectors(spark, d), load(spark, d, "embeddings"))
    return near.select("question", "vec_id", F.round(values.rescaled(F.col("cosine")), 6).alias("score"))


@query()
def kb_vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all, by the index; ``tests/test_vector_index.py`` measures its recall against ``kb_dense_cosine_topk``'s blocks."""
    index = VectorIndex.build(load(spark, d, "embeddings"))
    return index.topk(_asked_vectors(spark, d)).select("question", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


_HYBRID = f"""{_scored(_ITEMS)}, near as ({_NEAR}),
 blend as (select coalesce(s.question, r.question) as question, coalesce(s.doc_id, r.vec_id) as doc_id, coalesce(lexical, 0) as lex, coalesce(cosine, 0) as cosine from scored s full join near r on s.question = r.question and s.doc_id = r.vec_id),
 hybrid as (select question, doc_id, round(case when doc_id in (select vec_id from embeddings) then 0.62 * (case when cosine <= 0.32 then 0 else least(1.0, (cosine - 0.32) / 0.5) end) + 0.38 * lex else lex end, 9) as score from blend)"""


def _lexical_and_near(spark: SparkSession, d: str, groups: DataFrame, scales: list[list[tuple[int, int]]]) -> tuple[DataFrame, DataFrame]:
    """The scores that blended ranks can need: of all that are near by their vectors, and the first of each group (doc_id, group), whose scores differ by one of the factors ``scales``."""
    index, asked = index_of(spark, d), questions(spark, d)
    near = kept(search.dense(_asked_vectors(spark, d), load(spark, d, "embeddings")).withColumnRenamed("vec_id", "doc_id"), "near")
    first = index.best(asked, search.TOP_K, groups=groups.groupBy("doc_id").agg(F.min("group").alias("group")), scales=scales)
    scores = first.select("question", "doc_id", "lexical").unionByName(index.scores_of(near, asked))
    return scores.groupBy("question", "doc_id").agg(F.max("lexical").alias("lexical")), near


@query(_HYBRID + " select question, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by question order by score desc, doc_id) as rank from hybrid where score > 0.02) where rank <= 14")
def kb_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("v").alias("group"))
    lexical, near = _lexical_and_near(spark, d, vectors, [[(38, 100)]])
    hits = search.ranked(search.blended(lexical, near, vectors))
    return hits.select("question", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    _HYBRID
    + """, own as (select question, doc_id, round(case when doc_id % 4 < 3 and doc_id in (select doc_id from documents) and 'p' || doc_id % 4 <> 'p' || question % 3 then score * 0.4 else score end, 9) as score from hybrid)
 select question, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by question order by score desc, doc_id) as rank from own where score > 0.02) where rank <= 14"""
)
def kb_plan_topk(spark: SparkSession, d: str) -> DataFrame:
    """O-JOIN-8: three documents in four belong to one of three plans, and count less for the questions of another."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    owners = load(spark, d, "documents").where("doc_id % 4 < 3").select("doc_id", F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string")).alias("owner"))
    # A passage's owner and whether it has a vector decide by what its score is multiplied.
    groups = vectors.select("doc_id", F.lit("v").alias("v")).join(owners, "doc_id", "full").groupBy("doc_id").agg(F.concat(F.coalesce(F.min("v"), F.lit("")), F.coalesce(F.min("owner"), F.lit(""))).alias("group"))
    lexical, near = _lexical_and_near(spark, d, groups, [[(38, 100)], [(4, 10)], [(38, 100), (4, 10)]])
    scored = search.blended(lexical, near, vectors)
    weighed = search.penalised(scored, owners, F.concat(F.lit("p"), (F.col("question") % 3).cast("string")))
    hits = search.ranked(weighed.select("question", "doc_id", F.round("score", 9).alias("score")))
    return hits.select("question", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    _scored(_ITEMS)
    + """, placed as (select question, doc_id, source, lexical, row_number() over (partition by question, source order by lexical desc, doc_id) as place from scored join documents using (doc_id) where lexical > 0.02)
 select question, doc_id, source, round(lexical, 6) as score, rank from (select *, row_number() over (partition by question order by (place > 3)::int, lexical desc, doc_id) as rank from placed) where rank <= 4"""
)
def kb_diversified_topk(spark: SparkSession, d: str) -> DataFrame:
    sources = load(spark, d, "documents").select("doc_id", F.col("source").alias("group"))
    scored = index_of(spark, d).best(questions(spark, d), 4, groups=sources).select("question", "doc_id", F.col("lexical").alias("score"), F.col("group").alias("source"))
    hits = search.diversified(scored, "source", k=4)
    return hits.select("question", "doc_id", "source", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    _scored(_ITEMS)
    + """, hits as (select * from (select *, row_number() over (partition by question order by lexical desc, doc_id) as rank from scored where lexical > 0.02) where rank <= 14),
 wants as (select question, count(*) as wanted from asked group by question), covers as (select a.question, count(distinct a.term) as covered from asked a join hits h on a.question = h.question and h.rank <= 3 join posted p on p.doc_id = h.doc_id and p.term = a.term group by a.question)
 select i.item_id as question, round(h.lexical, 6) as top, round(coalesce(covered, 0) / wanted, 6) as coverage, round(case when h.lexical is null then 0 when wanted is null then least(1.0, h.lexical) else least(1.0, 0.7 * h.lexical + 0.3 * coalesce(covered, 0) / wanted) end, 6) as confidence
 from benchmark i left join hits h on h.question = i.item_id and h.rank = 1 left join wants w on w.question = i.item_id left join covers c on c.question = i.item_id"""
)
def kb_coverage_confidence(spark: SparkSession, d: str) -> DataFrame:
    index, asked = index_of(spark, d), questions(spark, d)
    hits = kept(index.topk(asked), "hits")
    return search.confidence(hits, asked, index.held(hits.where("rank <= 3")))


@query(
    """select count(*) as docs, count(l.doc_id) as labelled, count(*) - count(l.doc_id) as pending, sum(n_chars)::bigint as total_chars from documents d left join (select distinct doc_id from labels) l using (doc_id)"""
)
def kb_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """O-AGG-8."""
    known = load(spark, d, "labels").select("doc_id", F.lit(1).alias("known")).distinct()
    met = load(spark, d, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    return met.agg(F.count("*").alias("docs"), F.count("known").alias("labelled"), (F.count("*") - F.count("known")).alias("pending"), F.sum("n_chars").alias("total_chars"))


@query("select doc_id, source, lang from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id desc) as rn from documents) where rn = 1 or source = 'src0'")
def kb_newest_version(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return store.newest(docs, ["source", "lang"], ["n_chars", "doc_id"], F.col("source") == "src0").select("doc_id", "source", "lang")


@query("select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 0)")
def kb_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    return store.without(load(spark, d, "documents").select("doc_id", "source"), load(spark, d, "labels").where("quality = 0"), "doc_id")


@query("select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def kb_pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """O-SET-2, O-SNK-14."""
    return store.without(load(spark, d, "documents").select("doc_id"), load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("select doc_id, e.vec_id is not null as embedded, coalesce(e.label, -1) as label, round(coalesce(list_sum(embedding::double[]), 0), 6) as vec_sum from documents d left join embeddings e on e.vec_id = d.doc_id")
def kb_patch_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("embedded"))
    new = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    total = F.aggregate(F.coalesce("embedding", F.array().cast("array<float>")), F.lit(0.0), lambda acc, x: acc + x)
    return store.patched(docs, new, "doc_id", "embedding", "embedded").select("doc_id", "embedded", F.coalesce("label", F.lit(-1)).alias("label"), F.round(total, 6).alias("vec_sum"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc nulls last, o_orderkey limit 50")
def kb_docs_newest_first(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(50)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("select doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 300) as snippet, coalesce(nullif(source, ''), 'Untitled') as title, round(n_chars / 1024.0, 2) as kb from documents")
def kb_snippets(spark: SparkSession, d: str) -> DataFrame:
    """O-PRJ-1."""
    flat = F.left(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")), F.lit(300))
    return load(spark, d, "documents").select("doc_id", flat.alias("snippet"), F.coalesce(F.nullif("source", F.lit("")), F.lit("Untitled")).alias("title"), F.round(F.col("n_chars") / 1024.0, 2).alias("kb"))


@query()
def kb_chunks(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import chunking

    return chunking.chunk(load(spark, d, "documents").select("doc_id", "text"))


@query(f"""select term, {in_sql.stem("term")} as stem from (select distinct unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1)) as term from documents)""")
def kb_stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the distinct vocabulary, each worked out once."""
    words = load(spark, d, "documents").select(F.explode(text.terms(F.col("text"))).alias("term")).distinct()
    return words.select("term", text.stem(F.col("term")).alias("stem"))


@query(
    """select source, doc_id, left(text, (14000 - used)::bigint) as body from (select source, doc_id, text, rn, coalesce(sum(length(text) + length(source) + 12) over (partition by source order by rn rows between unbounded preceding and 1 preceding), 0) as used
 from (select *, row_number() over (partition by source order by doc_id) as rn from documents)) where 14000 - used > case when rn = 1 then 0 else 200 end"""
)
def kb_context_budget(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import answers

    docs = load(spark, d, "documents")
    # A passage costs 12 characters at least, so only so many ranks can matter: they are found without the texts.
    placed = docs.select("source", "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    placed = placed.where(F.col("rank") <= answers.CONTEXT_CHARS // 12 + 1).join(docs.select("doc_id", "text"), "doc_id")
    return answers.within_budget(placed, "source", "text", F.length("source")).select("source", "doc_id", "body")
