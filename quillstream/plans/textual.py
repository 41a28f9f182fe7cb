"""Text, markup and parsing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import classify
from ..session import load
from .registry import query

_UNITS = ["lakh", "lacs", "crore", "cr", "k", "", "million", "apples"]


@query(
    f"""with t as (select doc_id, concat_ws(' ', left(text, 40), 'about ' || format('{{:,}}', n_chars) || case when doc_id % 2 = 0 then '.5' else '' end, {_UNITS}[doc_id % {len(_UNITS)} + 1]) as s from documents),
 p as (select doc_id, regexp_extract(s, '(?i)([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*(lakhs?|lacs?|crores?|cr|k|million|m)?\\b', 1) as n, lower(regexp_extract(s, '(?i)([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*(lakhs?|lacs?|crores?|cr|k|million|m)?\\b', 2)) as u from t),
 v as (select doc_id, try_cast(replace(n, ',', '') as decimal(18,4)) * case when u like 'la%' then 100000 when u like 'cr%' then 10000000 when u = 'k' then 1000 when u like 'm%' then 1000000 else 1 end as amount from p)
 select doc_id, case when amount >= 1000 then amount::double end as amount from v"""
)
def text_amount_parse(spark: SparkSession, d: str) -> DataFrame:
    """O-MTH-6: the first amount in the head of every document, its length and a unit put behind it."""
    number = F.concat(F.lit("about "), F.format_number("n_chars", 0), F.when(F.col("doc_id") % 2 == 0, ".5").otherwise(""))
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("doc_id") % len(_UNITS) + 1).cast("int"))
    rows = load(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.left("text", F.lit(40)), number, unit).alias("s"))
    return rows.select("doc_id", text.amount(F.col("s")).cast("double").alias("amount"))


@query(
    """with v as (select distinct unnest(string_split(lower(p_name), ' ')) as word from part), tok as (select distinct substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) as token from v where length(word) >= 4),
 odd as (select token from tok where length(token) >= 3 and not regexp_matches(token, '[0-9]') and token not in (select word from v)),
 p as (select token, word, damerau_levenshtein(token, word) as dist from odd join v on abs(length(token) - length(word)) <= 2 and (substr(token, 1, 1) = substr(word, 1, 1) or substr(token, 2, 1) = substr(word, 2, 1)))
 select token, word, dist from (select *, row_number() over (partition by token order by dist, (substr(token, 1, 1) = substr(word, 1, 1)) desc, word) as r from p where dist <= case when length(token) <= 5 then 1 else 2 end and not (dist >= 2 and length(token) <> length(word))) where r = 1"""
)
def text_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    words = load(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    w = F.col("word")
    tokens = words.where(F.length(w) >= 4).select(F.concat(w.substr(1, 1), w.substr(3, 1), w.substr(2, 1), F.substring(w, 4, 99)).alias("token")).distinct()
    return classify.spelled(tokens, words.withColumn("df", F.lit(1))).select("token", "word", F.col("dist").cast("long").alias("dist"))


@query(
    """with t as (select item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1) as w from benchmark), p as (select item_id, w, unnest(range(1, length(w))) as i from t where length(w) >= 2)
 select item_id, w[i] || ' ' || w[i + 1] as bigram, count(*) as n from p group by 1, 2"""
)
def text_bigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "benchmark").select("item_id", F.explode(text.bigrams(text.terms(F.col("text")))).alias("bigram"))
    return rows.groupBy("item_id", "bigram").agg(F.count("*").alias("n"))


@query(
    """select page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug, upper(left(t, 1)) || substr(t, 2) as title from (select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(url, '\\.[^.]+$', ''), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) as t from pages)"""
)
def text_title_slug(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.title_of(F.col("url")).alias("title"))


@query(
    """select page_id, length(t) as n, md5(t) as digest from (select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') as t from pages)"""
)
def text_html_strip(spark: SparkSession, d: str) -> DataFrame:
    bare = load(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t"))
    return bare.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("select event_id, (json_extract(props, '$.k'))::bigint as k from events where json_extract(props, '$.k') is not null")
def text_json_props(spark: SparkSession, d: str) -> DataFrame:
    """O-JSN-1, O-JSN-2."""
    k = F.from_json("props", "k bigint")["k"]
    return load(spark, d, "events").select("event_id", k.alias("k")).where("k is not null")


@query(
    """select page_id, case when ends_with(h, '@m.example.net') then left(h, length(h) - length('m.example.net')) || 'example.net' else h end as address from (select page_id, lower(trim('User' || page_id || '@' || case when page_id % 3 = 0 then 'm.example.net' else 'example.org' end)) as h from pages)"""
)
def text_domain_rewrite(spark: SparkSession, d: str) -> DataFrame:
    host = F.when(F.col("page_id") % 3 == 0, "m.example.net").otherwise("example.org")
    return load(spark, d, "pages").select("page_id", text.rewrite_domain(F.concat(F.lit("User"), F.col("page_id").cast("string"), F.lit("@"), host), "m.example.net", "example.net").alias("address"))


@query(
    """select o_orderkey, (extract(year from e) - extract(year from s)) * 12 + extract(month from e) - extract(month from s) - case when extract(day from e) < extract(day from s) then 1 else 0 end as months from (select o_orderkey, o_orderdate::date as s, date '1999-03-15' as e from orders)"""
)
def text_tenure_months(spark: SparkSession, d: str) -> DataFrame:
    """O-DAT-5."""
    months = values.tenure_months(F.to_date("o_orderdate"), F.lit("1999-03-15").cast("date"))
    return load(spark, d, "orders").select("o_orderkey", months.cast("long").alias("months"))


@query("select doc_id, case when n_chars < 1024 then n_chars || ' B' else case when n_chars < 1048576 then floor(n_chars / 1024.0 + 0.5)::bigint || ' KB' else printf('%.1f MB', n_chars / 1048576.0) end end as shown, case when length(source) > 4 then left(source, 4) || '…' else source end as short from documents")
def text_shown_sizes(spark: SparkSession, d: str) -> DataFrame:
    """O-MTH-9, O-STR-13."""
    return load(spark, d, "documents").select("doc_id", values.byte_size(F.col("n_chars")).alias("shown"), text.clip(F.col("source"), 4).alias("short"))


@query()
def text_decoded_pages(spark: SparkSession, d: str) -> DataFrame:
    """O-STR-9 with numeric entities, in Arrow batches."""
    return load(spark, d, "pages").select("page_id", text.decode_entities(F.regexp_replace("html", "<[^>]*>", "")).alias("text"))
