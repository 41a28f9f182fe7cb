"""Line deduplication by an exact set-similarity join (operator 2, DataFrame functions only).

A line is the set of its lower-case words, told apart by 64-bit hashes. An exact vocabulary counts every word of
the corpus; a table of at most ``2**MOST_BITS`` bytes, sized by the vocabulary, tells the rarity of a word, and words
are ordered by it, rarest first, then by hash. The rarest word that two sets of Jaccard similarity 0.8 or more share is one of
the first ``n - ceil(0.8 n) + 1`` of both, so lines are joined on the words of these prefixes. The words from the shared
one on must suffice for the overlap in either line: that comparison is the positional and the length filter. Sets
differ in at most a ninth of their sizes together, and so do the parities of their words in 128 slots, which the join compares: words of
both lines cancel out. Lines of a word meet by classes of sizes, the smaller set against the sizes that its place in it leaves. Pairs
that pass are verified by all their words. A line goes if an earlier line (by doc_id and line
number) is equal as a set or similar; all lines, gone ones too, count as earlier lines.

Equal sets are one class with its first occurrence, so copies of a line never meet. A word that joins more than
``HOT`` lines stands for families of near copies, or is one of the many that a large corpus brings: there each line is first held
against the earliest of the word's lines alone, and the lines that this leaves unmatched meet the others of the word. That join counts
its pairs first. Words with more pairs than lines, and those of over ``LARGE`` lines, compare all words inside the join, in
blocks of ``BLOCK`` lines; all others, which few pairs pass, are joined with the words that are not hot, so that rows carry no words.
The line that is named as kept is an earlier similar one, and the earliest such line unless hot words brought the two together.

Defined cases: blank lines and null texts have no words and stay; rows with a null doc_id come after all
others (2^63-1 stands for it inside); rows that share a doc_id are told apart by their texts, so equal ones count once; lines of any
length take part whole; among repeats the least doc_id, text hash and line number comes first; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, release, table

MOST_BITS = 24
HOT, BLOCK, LARGE = 512, 4096, 1 << 16
#: Rarity is counted in quarters of a doubling.
_STEPS, _NO_ID = 4, (1 << 63) - 1
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _rows(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, list[str]]:
    """The rows with texts in lower case and no white space but blanks and line ends, and what names a line of theirs.

    The earlier of two lines has the smaller name. ``twin`` tells rows of one doc_id apart where there are any.
    """
    low = F.lower(F.col(text))
    other = "\t\x0b\x0c\r"
    odd = F.contains(low, F.lit(other[0]))
    for c in other[1:]:
        odd = odd | F.contains(low, F.lit(c))
    row = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))
    alone = docs.groupBy(row.alias("row")).count().where("count > 1").isEmpty()
    twin = [] if alone else [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("twin")]
    named = docs.select(row.alias("row"), *twin, F.when(odd, F.translate(low, other, "    ")).otherwise(low).alias("text"))
    return named, ["row", "line_no"] if alone else ["row", "twin", "line_no"]


def _hashes(line: Column) -> Column:
    """Hashes of the distinct words. Blanks side by side give empty words, which are none."""
    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _rarity(rows: DataFrame) -> tuple[DataFrame, int]:
    """One row: the rarity of each slot of word hashes as an array of bytes, 0 where every word occurs once; and the bits of a slot."""
    words = rows.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = durable(words.groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("n")).where("n > 1"), "vocabulary")
    bits = min(MOST_BITS, max(12, counts.count().bit_length() + 1))
    level = F.least(F.floor(_STEPS * F.log2("n")), F.lit(127)).cast("byte")
    slot, page = F.col("h").bitwiseAND((1 << bits) - 1).cast("int"), bits - 10
    slots = counts.groupBy(slot.alias("slot")).agg(F.max(level).alias("level"))
    here = F.sort_array(F.collect_list(F.shiftleft(F.col("slot").bitwiseAND(1023), 7).bitwiseOR(F.col("level").cast("int"))))  # at most 1,024
    pages = slots.groupBy(F.shiftright("slot", 10).alias("page")).agg(here.alias("a"))
    gap = lambda n: F.array_repeat(F.lit(0).cast("byte"), n)
    place = lambda x: F.shiftright(x, 7)
    filled = F.flatten(F.transform("a", lambda x, i: F.concat(gap(place(x) - F.coalesce(place(F.get("a", i - 1)), F.lit(-1)) - 1), F.array(x.bitwiseAND(127).cast("byte")))))
    dense = F.concat(filled, gap(F.lit(1023) - place(F.element_at("a", -1))))
    every = rows.sparkSession.range(1 << page).select(F.col("id").cast("int").alias("page")).join(pages.select("page", dense.alias("levels")), "page", "left")
    whole = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("levels", gap(F.lit(1024))).alias("levels")))).alias("a"))
    out = durable(whole.select(F.flatten(F.transform("a", lambda x: x["levels"])).alias("levels")), "rarity")
    release(counts)
    return out, bits


def _need(n: Column) -> Column:
    """ceil(0.8 n)"""
    return F.floor((4 * n + 4) / 5).cast("int")


def _described(lines: DataFrame, name: list[str], levels: DataFrame, bits: int) -> DataFrame:
    """The names of lines with ``h1, h2, n, bits, prefix``: two hashes of the set, its size, parities of its words by slot, its rarest words and the one behind them.

    A word is a number of 30 bits, with the lowest bit set if the corpus has it ``HOT`` times, and negative if it has it once.
    """
    often = _STEPS * (HOT.bit_length() - 1)
    slot = lambda h: h.bitwiseAND((1 << bits) - 1).cast("int")
    level = lambda h: F.coalesce(F.get("levels", slot(h)), F.lit(0).cast("byte"))  # noqa: E731  never null, so that ranks are sorted as plain numbers
    rank = lambda h: F.shiftleft(level(h).cast("long"), 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1))
    zero = F.lit(0).cast("long")
    below = F.array_position(F.sort_array(F.array_append("h", zero)), zero).cast("int") - 1  # words with negative hashes
    # ``h`` as a column that a generator makes: were it an expression, the optimizer would not put the table of ``levels`` into ``rank``, but into every row.
    sets = lines.select(*name, F.sort_array(_hashes(F.col("line"))).alias("h")).select(*name, F.explode(F.array("h")).alias("h")).withColumn("levels", levels.scalar())
    told = sets.select(*name, F.xxhash64("h").alias("h1"), F.xxhash64(F.lit(1), "h").alias("h2"), F.size("h").alias("n"), below.alias("m"), "h", F.sort_array(F.transform("h", rank)).alias("t"))
    word = lambda x: F.shiftleft(x.bitwiseAND((1 << 30) - 1), 1)
    short = lambda x: F.when(x < 1 << 56, -1 - word(x)).otherwise(word(x).bitwiseOR((F.shiftright(x, 56) >= often).cast("long"))).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    bits_of = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda some, x: some.bitwiseXOR(bit(x)))
    both = F.struct(bits_of(F.slice("h", F.lit(1), F.col("m"))).alias("low"), bits_of(F.slice("h", F.col("m") + 1, F.col("n"))).alias("high"))
    return told.select(*name, "h1", "h2", "n", both.alias("bits"), F.transform(F.slice("t", F.lit(1), F.col("n") - _need(F.col("n")) + 2), short).alias("prefix"))


def _name(name: list[str], side: str) -> Column:
    return F.struct(*[F.col(f"{side}.{c}") for c in name])


def _before(name: list[str], a: str, b: str) -> Column:
    """Whether ``a`` is the earlier line."""
    before = F.lit(False)
    for c in reversed(name):
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        before = (x < y) | ((x == y) & before)
    return before


def _may_match(a: str, b: str) -> Column:
    """Whether entries ``a`` and ``b`` are of one word, their places leave enough words in both, and the parities of their words
    differ in no more slots than similar lines do in words. Unequal sets of one size differ in two words at least."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    both = x("n") + y("n")
    differ = F.bit_count(x("bits.low").bitwiseXOR(y("bits.low"))) + F.bit_count(x("bits.high").bitwiseXOR(y("bits.high")))
    return (x("token") == y("token")) & (9 * F.least(x("left"), y("left")) >= 4 * both) & (9 * differ <= both) & ((both >= 18) | (both.bitwiseAND(1) == 1))


def _sets(pairs: DataFrame, rows: DataFrame, name: list[str]) -> DataFrame:
    """``name, t``: the words of all lines in the pairs (a, b), as hashes.

    A bitmap of fixed size, which never misses a row or a line in question, keeps nearly all other texts from being split and
    nearly all other lines from being shuffled.
    """
    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().select("name.*"), "pair-ends")
    row, line, slots = F.xxhash64(*[c for c in name if c != "line_no"]), F.xxhash64(*name), 1 << 18
    slot = lambda h: F.shiftright(h, 6).bitwiseAND(slots - 1).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    words = ends.select(F.explode(F.array(row, line)).alias("h")).groupBy(slot(F.col("h")).alias("w")).agg(F.bit_or(bit(F.col("h"))).alias("v"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    whole = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("a"))
    bitmap = durable(whole.select(F.transform("a", lambda x: x["v"]).alias("bitmap")), "pair-rows").scalar()
    listed = lambda h: F.get(bitmap, slot(h)).bitwiseAND(bit(h)) != 0
    lines = _lines(rows.where(listed(row))).where(listed(line)).join(ends, name, "left_semi").dropDuplicates(name)
    out = durable(lines.select(F.struct(*name).alias("name"), _hashes(F.col("line")).alias("t")), "pair-lines")
    release(ends)
    return out


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of names whose lines have a Jaccard similarity of 0.8 or more."""
    x, y = sets.select(F.col("name").alias("a"), F.col("t").alias("x")), sets.select(F.col("name").alias("b"), F.col("t").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return durable(pairs.join(x, "a").join(y, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "similar")


def _verified(pairs: DataFrame, rows: DataFrame, name: list[str]) -> DataFrame:
    """For each later line ``b`` of the pairs the earliest ``a`` that is similar. The filters leave few false pairs, so
    nearly every ``b`` is done with its earliest candidate; only those whose one fails meet all their others."""
    sets = _sets(pairs, rows, name)
    earliest = durable(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "earliest")
    sure = _similar(earliest, sets)
    others = durable(pairs.join(sure, "b", "left_anti").join(earliest, ["a", "b"], "left_anti"), "other-pairs")
    found = sure if others.isEmpty() else sure.unionByName(_similar(others, sets).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    release(pairs, earliest, others, sets)
    return found


def _met(name: list[str], a: DataFrame, b: DataFrame, also: Column | None = None) -> DataFrame:
    """``a, b``: names of the lines of entries that may match, ``a`` the earlier one."""
    on = _may_match("a", "b") & _before(name, "a", "b")
    return a.alias("a").join(b.alias("b"), on if also is None else on & also).select(_name(name, "a").alias("a"), _name(name, "b").alias("b")).distinct()


def _size_class(n: Column) -> Column:
    """Classes of sizes, eight to a doubling; a size of less than 12 is its own."""
    known = F.when(n < 12, n).otherwise(12 + F.floor(8 * F.log2(n / 12))).cast("int")
    return F.coalesce(known, F.lit(0))  # never null, else a filter for nulls would go under the shuffle of one side only


@contextmanager
def _dealt_by_token(spark: SparkSession) -> Iterator[None]:
    """While it holds, Spark joins on more keys than a shuffle has dealt by, without another shuffle."""
    before = spark.conf.get(_ALL_KEYS, None)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.unset(_ALL_KEYS) if before is None else spark.conf.set(_ALL_KEYS, before)


def _met_by_size(name: list[str], entries: DataFrame) -> DataFrame:
    """``token, a, b`` of all ``entries`` that may match, dealt by token (``_dealt_by_token``), where ``done`` does not hold for the later line.

    Both sides read one shuffle by token: a row is split by classes behind it, as the larger set (-1) and as the smaller one of
    each class of sizes that it may meet. The two roles come out of one generator, else the optimizer would filter, and so shuffle, each side for itself.
    """
    most = F.floor((9 * F.col("left") - 4 * F.col("n")) / 4).cast("int")  # the largest set that has the overlap
    roles = F.sequence(F.lit(-1), F.when(most >= F.col("n"), _size_class(most) - _size_class(F.col("n"))).otherwise(F.lit(-1)))
    split = entries.select("*", F.explode(roles).alias("role"))
    x = split.where("role >= 0").withColumn("size_class", F.coalesce(_size_class(F.col("n")) + F.col("role"), F.lit(0)))
    y = split.where("role = -1").withColumn("size_class", _size_class(F.col("n")))
    first = _before(name, "x", "y")
    in_order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & first)
    to_do = ~F.when(first, F.col("y.done")).otherwise(F.col("x.done"))
    met = x.alias("x").join(y.alias("y"), _may_match("x", "y") & (F.col("x.size_class") == F.col("y.size_class")) & in_order & to_do)
    one, two = _name(name, "x"), _name(name, "y")
    return met.select("x.token", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))


def _dense_matches(entries: DataFrame, counts: DataFrame, rows: DataFrame, name: list[str]) -> DataFrame:
    """Matches (a, b) among the entries of words that have many similar pairs, or more lines than one task should meet."""
    blocks = counts.select("token", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    placed = entries.join(blocks, "token")
    left = placed.where("not done").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    all_ = placed.withColumn("block", F.pmod(F.xxhash64(*name), "blocks"))
    # All words are compared inside the join: pairs that are not similar, of which families of near copies have a square, never leave it.
    sets = _sets(entries.select(F.struct(*name).alias("a"), F.struct(*name).alias("b")), rows, name)
    words = sets.select("name.*", "t")
    similar = 9 * F.size(F.array_intersect("a.t", "b.t")) >= 4 * (F.size("a.t") + F.size("b.t"))
    rest = durable(_met(name, all_.join(words, name), left.join(words, name), (F.col("a.block") == F.col("b.block")) & similar), "rest")
    release(sets)
    return rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, line_no, kept_doc_id, kept_line_no, twin`` of every line that an earlier one makes redundant."""
    rows, name = _rows(docs, text, doc_id)
    levels, bits = _rarity(rows)
    described = durable(_described(_lines(rows), name, levels, bits), "lines")
    here = described.where("n > 0")
    # The earliest of each class, with all that the join needs of it; copies of a line end here.
    first = F.min(F.struct(*name, "n", "bits", "prefix")).alias("first")
    classes = durable(here.groupBy("h1", "h2").agg(first, F.count("*").alias("lines")).select("h1", "h2", "lines", "first.*"), "line-classes")
    slim = here.select(F.struct(*name).alias("name"), "h1", "h2")
    slim = durable(slim if "twin" not in name else slim.distinct(), "line-names")
    release(levels, described)

    def entries(lines: DataFrame) -> DataFrame:
        """No column is null: filters for nulls would go under the shuffle of one side of a join, and two shuffles be made."""
        sure = lambda *names: [F.coalesce(F.col(c), F.lit(False if c == "done" else 0)).alias(c.split(".")[-1]) for c in names]
        whole = lines.select(*sure(*name, "n", *(c for c in lines.columns if c == "done")), F.struct(*sure("bits.low", "bits.high")).alias("bits"), "prefix")
        places = whole.select("*", F.posexplode("prefix").alias("p", "token")).drop("prefix").where((F.col("token") >= 0) & (F.col("p") <= F.col("n") - _need(F.col("n"))))
        return places.withColumns({"token": F.coalesce("token", F.lit(0)), "left": F.col("n") - F.col("p")}).drop("p")

    frequent = classes.select(F.explode("prefix").alias("token")).where("token & 1 = 1 and token >= 0")
    hot_words = durable(frequent.groupBy("token").count().where(F.col("count") > HOT), "hot-words")
    matched = []
    if hot_words.isEmpty():
        cold = entries(classes).repartition("token").withColumn("done", F.lit(False))
    else:
        hot = entries(classes).where("token & 1 = 1").join(hot_words, "token", "left_semi")
        leaders = hot.groupBy("token").agg(F.min(F.struct(*name, "n", "left", "bits")).alias("l")).select("token", "l.*")
        matched.append(_verified(durable(_met(name, leaders, hot), "star"), rows, name))
        flags = matched[0].select("b.*", F.lit(True).alias("flag"))
        flagged = durable(classes.join(flags, name, "left").select(*classes.columns, F.col("flag").isNotNull().alias("done")), "flagged")
        release(classes)
        classes = flagged
        hot = durable(entries(classes).where("token & 1 = 1").join(hot_words, "token", "left_semi"), "hot-entries")
        large = F.col("count") > LARGE
        few = hot.repartition("token").join(hot_words.where(large), "token", "left_anti")
        pairs = _met_by_size(name, few).groupBy("token").agg(F.count("*").alias("pairs"))
        with _dealt_by_token(docs.sparkSession):
            kinds = durable(hot_words.join(pairs, "token", "left").select("token", "count", (large | (F.coalesce("pairs", F.lit(0)) > F.col("count"))).alias("dense")), "hot-kinds")
        dense = durable(kinds.where("dense").select("token", "count"), "dense-words")
        crowded = durable(hot.join(dense, "token", "left_semi"), "dense-entries")
        matched.append(_dense_matches(crowded, dense, rows, name))
        release(hot, crowded)
        known = entries(classes).repartition("token").join(kinds.select("token", "dense"), "token", "left")
        cold = known.where("dense is null or not dense").withColumn("done", F.col("done") & F.col("dense").isNotNull()).drop("dense")
    with _dealt_by_token(docs.sparkSession):
        pairs = durable(_met_by_size(name, cold).select("a", "b").distinct(), "pairs")
    matched = reduce(DataFrame.unionByName, [*matched, _verified(pairs, rows, name)])
    matched = durable(matched.groupBy("b").agg(F.min("a").alias("kept")), "matched")

    copied = classes.where("lines > 1").select("h1", "h2", F.struct(*name).alias("first"))
    firsts = copied.join(matched, F.col("first") == F.col("b"), "left").select("h1", "h2", "first", F.coalesce("kept", "first").alias("kept"))
    copies = slim.join(firsts, ["h1", "h2"]).where("name <> first").select("name", "kept")
    gone = copies.unionByName(matched.select(F.col("b").alias("name"), "kept"))
    known = lambda x: F.nullif(x, F.lit(_NO_ID))
    twin = F.col("name.twin") if "twin" in name else F.lit(0).cast("long")
    return gone.select(known(F.col("name.row")).alias("doc_id"), "name.line_no", known(F.col("kept.row")).alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), twin.alias("twin"))


def cut_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the lines listed in ``gone``, all columns kept. A ``twin`` of 0 holds for all rows of its doc_id."""
    numbers = gone.groupBy(F.col("doc_id").alias("_d"), F.col("twin").alias("_t")).agg(F.collect_set("line_no").alias("_gone"))  # line numbers of one text
    mine = F.col("_t").isin(0) | (F.col("_t") == F.xxhash64(F.coalesce("text", F.lit(""))))
    met = docs.join(numbers, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & mine, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    cut = met.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)


def op2_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents")).drop("twin")
