"""Quality rules with adaptive thresholds (operator 6, DataFrame functions only).

Every document gets counts of words, symbols, repeated lines and repeated word windows. The fixed base
rules reject some documents; the others are held against fences that come from mergeable KLL quantile
sketches of each (lang, source) group. A fence lies beyond a high (or low) quantile by ``TAIL`` times the distance
of that quantile from the median, so it follows the spread of the group. Symbols and word lengths are measured at the
first or last tenth, which junk of less than a tenth of a group does not move; repeats, which most groups have
a few of, at the last hundredth. Where most of a group agree, the distance is at least ``LEAST_SPREAD`` of the middle for word lengths, and for rates
one occurrence in a long text (0.9 quantile) of the group, so no fence closes upon the middle. From there a fence follows the tail: while the next of the
quantiles ``TAILS`` lies within it, the fence is measured from that one, so a tail without a gap belongs to its group and junk beyond a gap does not. Rates count what goes beyond ``FREE`` occurrences, so that no single event rejects a short text. Small
groups borrow: the fence of a group of n documents is its own by n / (n + ``BORROW``), and for the rest that of
its language, which borrows from the corpus in the same way; all come from the same sketches, merged.

Defined cases: a null text is empty; a null lang or source is a group of its own; an empty table gives an
empty result; repeated rows are each judged; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, durable, let, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SKETCH_K, TAIL, BORROW = 1024, 3.0, 200
LEAST_SPREAD, TAILS = 0.05, (0.925, 0.95, 0.975, 0.99)
#: Feature: its count, what it is counted per, the occurrences that are free, and the quantiles of its low and high fence.
FEATURES = {
    "word_length": ("word_chars", "n_words", 0, (0.1, 0.9)),
    "symbol_ratio": ("n_symbols", "n_words", 2, (None, 0.9)),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 2, (None, 0.99)),
    "repeat_ratio": ("n_repeat_words", "n_words", 6, (None, 0.99)),
}
SKETCHED = [*FEATURES, "n_words", "n_lines"]


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""

    def seek(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        windows = F.sort_array(F.slice(F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"), F.sequence(F.lit(0), n - 1).alias("i")), 1, n - 2))
        return F.when(n < 3, 0).when(F.size(F.array_distinct(hashes)) == n - 2, 0).otherwise(let(windows, _covered))

    return let(words, seek)


def _covered(windows: Column) -> Column:
    """``windows``: structs (word, word, word, position), sorted; equal ones stand next to each other."""
    alike = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twice = F.filter(windows, lambda x, k: F.coalesce(alike(x, F.get(windows, k - 1)), F.lit(False)) | F.coalesce(alike(x, F.get(windows, k + 1)), F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    add = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), add)["n"]


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts of every document, with its group."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    words = ascii_words(F.col(text))
    counted = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), counted.alias("c"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).alias("n_lines"),
    ).select(
        "doc_id", "lang", "source", F.col("c.n_words").cast("long").alias("n_words"), F.col("c.word_chars").cast("long").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("c.n_repeat_words").cast("long").alias("n_repeat_words"), "n_lines"
    )


def _rates(df: DataFrame) -> DataFrame:
    rate = lambda count, per, free: F.when(F.col(per) > 0, F.greatest(F.col(count) - free, F.lit(0)) / F.col(per)).otherwise(0.0)
    return df.withColumns({name: rate(count, per, free) for name, (count, per, free, _) in FEATURES.items()})


def _fence(sketches: str, feature: str, q: float) -> Column:
    """``TAIL`` spreads beyond the quantile ``q`` of a feature, or beyond the farthest quantile that its tail reaches without a gap."""
    at = lambda name, x: F.kll_sketch_get_quantile_double(F.col(f"{sketches}.{name}"), F.lit(x))
    middle, low = at(feature, 0.5), q < 0.5
    least = LEAST_SPREAD * middle if feature == "word_length" else 1 / at(FEATURES[feature][1], 0.9)
    edge = lambda x: x + (-TAIL if low else TAIL) * F.greatest(F.abs(x - middle), least)
    within = lambda x, limit: x >= limit if low else x <= limit
    tail = [at(feature, 1 - x if low else x) for x in TAILS if x > max(q, 1 - q)]
    start = F.struct(at(feature, q).alias("x"), F.lit(True).alias("on"))  # on: no gap so far

    def follow(e: Column, x: Column) -> Column:
        on = e["on"] & within(x, edge(e["x"]))
        return F.struct(F.when(on, x).otherwise(e["x"]).alias("x"), on.alias("on"))

    return let(F.aggregate(F.array(*tail), start, follow)["x"], edge) if tail else edge(at(feature, q))


def fences(rated: DataFrame) -> DataFrame:
    """``lang, source`` and a low and a high fence for each feature. ``rated`` holds the documents that passed the base rules."""
    sketched = durable(rated.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(c).cast("double"), SKETCH_K).alias(c) for c in SKETCHED]), "rule-sketches")

    def merged(*keys: str) -> DataFrame:
        return sketched.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, SKETCH_K).alias(c) for c in SKETCHED])

    level = lambda df, tag: df.select(*[c for c in ("lang", "source") if c in df.columns], F.struct("n", *SKETCHED).alias(tag))
    joined = (
        level(sketched, "own")
        .join(level(merged("lang"), "of_lang").withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
        .join(F.broadcast(level(merged(), "of_all")), F.lit(True), "left")  # one row
    )
    part = lambda tag: F.col(f"{tag}.n") / (F.col(f"{tag}.n") + BORROW)
    out = []
    for c, (_, _, _, (low, high)) in FEATURES.items():
        for side, q in (("low", low), ("high", high)):
            if q is None:
                out.append(F.lit(float("-inf")).alias(f"{c}_{side}"))
                continue
            wider = part("of_lang") * _fence("of_lang", c, q) + (1 - part("of_lang")) * _fence("of_all", c, q)
            out.append((part("own") * _fence("own", c, q) + (1 - part("own")) * wider).alias(f"{c}_{side}"))
    return joined.select("lang", "source", *out)


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document."""
    counted = durable(features(docs, text, doc_id), "rule-counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rated = _rates(counted).withColumn("base_failed", failed)
    limits = fences(rated.where(~F.col("base_failed"))).withColumnsRenamed({"lang": "l", "source": "s"})
    within = F.lit(True)
    for c in FEATURES:
        within = within & F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high"))
    met = rated.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lang", "source", *FEATURES)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
