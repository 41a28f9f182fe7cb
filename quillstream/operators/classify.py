"""Classifiers over text columns: intents, fields, guards, spelling and dialogue state.

Operators: O-CLS-1 to O-CLS-9, O-WIN-9, O-WIN-13, O-STR-15, O-STR-16, O-AGG-26, O-JOIN-15, O-RUL-6, O-RUL-7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import kept

# Fixed values.
ESCALATE, ANSWER, MARGIN, OFFER = 0.30, 0.60, 0.10, 0.12
PREFIX_WEIGHT, EDIT_WEIGHT, BIGRAM_STEP, BIGRAM_MOST, KEYWORD_STEP, KEYWORD_MOST = 0.65, 0.55, 0.09, 0.18, 0.04, 0.08
EXACT, CONTAINED, UNSEEN, ALONE = 0.25, 0.12, 0.35, 0.72
# End of fixed values.


def fields_of(low: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that the text matches, in order, joined (O-CLS-4)."""
    return F.concat_ws(",", *[F.when(low.rlike(text.plain_edges(p)), F.lit(name)) for name, p in patterns.items()])


def model_stats(utterances: DataFrame) -> DataFrame:
    """``term, df, idf`` over intents from (intent, text) rows (O-AGG-26)."""
    pairs = utterances.select("intent", F.explode(text.tokenize(F.col("text"))).alias("term")).distinct()
    n = utterances.agg(F.countDistinct("intent").alias("n"))
    return pairs.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 0.5)) + 0.25).alias("idf"))


def intent_scores(questions: DataFrame, models: DataFrame, key: str = "item_id") -> DataFrame:
    """``key, intent, score``: weight of an intent's terms that a question has. Intents without a shared term score 0; ``models`` is a literal table (O-CLS-1, O-JOIN-15)."""
    asked = questions.select(key, F.explode(F.array_distinct(text.terms(F.col("text")))).alias("term"))
    totals = models.groupBy("intent").agg(F.sum("w").alias("total"))
    hits = asked.join(models, "term").groupBy(key, "intent").agg(F.sum("w").alias("got"))
    every = asked.select(key).distinct().crossJoin(totals)  # every question meets every intent
    return every.join(hits, [key, "intent"], "left").select(key, "intent", F.round(F.coalesce("got", F.lit(0.0)) / F.col("total"), 9).alias("score"))


def likeness(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``t, term, part``: what a question's term is worth to a term of the models that it only resembles (O-CLS-1).

    Both of four letters or more; one begins with the other, or they are one edit or swap apart. A prefix has its first four letters, and
    one edit leaves the first or the last letter as it is, so both come from equi-joins, and few pairs reach the edit distance.
    """
    t = asked.select("t").distinct().where(F.length("t") >= 4)
    w = known.select("term").distinct().where(F.length("term") >= 4)
    begun = t.withColumn("k", F.left("t", F.lit(4))).join(w.withColumn("k", F.left("term", F.lit(4))), "k").where("t <> term and (startswith(t, term) or startswith(term, t))")
    ends = lambda df, c: df.withColumn("k", F.explode(F.array(F.concat(F.lit("f"), F.left(c, F.lit(1))), F.concat(F.lit("l"), F.right(c, F.lit(1))))))
    sized = t.withColumn("n", F.explode(F.sequence(F.length("t") - 1, F.length("t") + 1)))
    close = ends(sized, "t").join(ends(w.withColumn("n", F.length("term")), "term"), ["k", "n"]).where((F.col("t") != F.col("term")) & F.levenshtein("t", "term", 2).between(0, 2)).select("t", "term").distinct()
    close = close.where(text.osa_distance("t", "term") <= 1)
    both = begun.select("t", "term", F.lit(PREFIX_WEIGHT).alias("part")).unionByName(close.select("t", "term", F.lit(EDIT_WEIGHT).alias("part")))
    return both.groupBy("t", "term").agg(F.max("part").alias("part"))


def intent_model_scores(questions: DataFrame, utterances: DataFrame, keywords: DataFrame, key: str = "item_id") -> DataFrame:
    """``key, intent, score`` of every question with a term against every intent (O-CLS-1, O-AGG-26, O-JOIN-15).

    ``utterances``: intent, ord, text; ``keywords``: intent, text. Terms are stems; those that no intent has weigh ``UNSEEN``.
    """
    asked = kept(questions.select(key, text.tokenize(F.col("text")).alias("tokens")).where(F.size("tokens") > 0), "asked").select(key, "tokens", F.array_join("tokens", " ").alias("joined"), F.array_distinct("tokens").alias("own"))
    said = kept(utterances.select("intent", "ord", text.tokenize(F.col("text")).alias("tokens")), "said").select("*", F.array_join("tokens", " ").alias("line"))
    model = kept(said.select("intent", F.explode("tokens").alias("term")).distinct(), "model")
    n = said.agg(F.countDistinct("intent").alias("n"))  # of intents, one row
    idf = lambda df: F.log((F.col("n") + 1) / (df + 0.5)) + 0.25
    df = model.groupBy("term").agg(F.count("*").alias("df"))
    words = asked.select(key, F.explode("own").alias("t")).join(df.withColumnRenamed("term", "t"), "t", "left")
    words = kept(words.crossJoin(F.broadcast(n)).select(key, "t", "df", (idf(F.coalesce("df", F.lit(0))) * F.when(F.col("df").isNull(), UNSEEN).otherwise(1.0)).alias("w")), "words")
    totals = words.groupBy(key).agg(F.sum("w").alias("total"))
    exact = words.join(model.withColumnRenamed("term", "t"), "t").select(key, "intent", "t", "w", F.lit(1.0).alias("part"))
    like = words.join(likeness(words, model), "t").join(model, "term").select(key, "intent", "t", "w", "part")
    best = exact.unionByName(like).groupBy(key, "intent", "t").agg((F.max("w") * F.max("part")).alias("m"))
    matched = best.groupBy(key, "intent").agg(F.sum("m").alias("matched"))

    # What each question meets is written once: the words of questions and models are read by six joins.
    pairs = said.select("intent", F.explode(text.bigrams(F.col("tokens"))).alias("b")).distinct()
    shared = asked.select(key, F.explode(text.bigrams(F.col("tokens"))).alias("b")).join(pairs, "b").groupBy(key, "intent").agg(F.count("*").alias("bigrams"))
    # Every question meets every utterance of the models, a literal table; the first that equals or contains decides.
    whole = asked.crossJoin(said.where("line <> ''").select("intent", "ord", "line")).where(F.contains("line", F.col("joined")) | F.contains("joined", F.col("line")))
    whole = whole.groupBy(key, "intent").agg(F.min_by(F.when(F.col("line") == F.col("joined"), EXACT).otherwise(CONTAINED), "ord").alias("whole"))
    keys = keywords.select("intent", F.explode(text.tokenize(F.col("text"))).alias("t")).distinct()
    hits = asked.select(key, F.explode("own").alias("t")).join(keys, "t").groupBy(key, "intent").agg(F.count("*").alias("keys"))
    alone = asked.where("size(own) = 1").select(key, F.col("own")[0].alias("term")).join(model, "term").join(df, "term").crossJoin(F.broadcast(n)).where(idf(F.col("df")) > 1.4).select(key, "intent", F.lit(ALONE).alias("alone"))

    every = asked.select(key).crossJoin(said.select("intent").distinct()).join(totals, key)
    for part in (matched, shared, whole, hits, alone):
        every = every.join(part, [key, "intent"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    base = none("matched") / F.col("total") + F.least(F.lit(BIGRAM_MOST), BIGRAM_STEP * none("bigrams")) + none("whole")
    score = F.greatest(base, none("alone")) + F.least(F.lit(KEYWORD_MOST), KEYWORD_STEP * none("keys"))
    return every.select(key, "intent", F.round(F.least(F.lit(1.0), score), 9).alias("score"))


def decided(scored: DataFrame, key: str = "item_id") -> DataFrame:
    """The best intent, its margin and what to do (O-WIN-9, O-CLS-2)."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "intent")
    best = scored.withColumns({"second": F.lead("score").over(w), "_r": F.row_number().over(w)}).where("_r = 1").drop("_r")
    margin = F.col("score") - F.col("second")
    decision = F.when(F.col("score") < ESCALATE, "escalate").when(F.col("score") >= ANSWER, "answer").otherwise("clarify")
    return best.withColumns({"margin": margin, "ambiguous": F.coalesce(margin < MARGIN, F.lit(False)), "decision": decision})


def spelled(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, word``: the nearest word of the vocabulary for tokens outside it (O-STR-15).

    Candidates share the first or second letter and differ by two in length at most; both are equi-join keys, so the
    edit distance runs on few pairs. ``vocabulary``: word, df.
    """
    odd = tokens.where((F.length("token") >= 3) & ~F.col("token").rlike("[0-9]")).distinct().join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    keyed = lambda df, c: df.withColumn("_k", F.explode(F.array_distinct(F.array(F.concat(F.lit("1"), F.substring(c, 1, 1)), F.concat(F.lit("2"), F.substring(c, 2, 1))))))
    near = keyed(odd.withColumn("_l", F.explode(F.sequence(F.length("token") - 2, F.length("token") + 2))), "token")
    words = keyed(vocabulary.withColumn("_l", F.length("word")), "word")
    pairs = near.join(words, ["_k", "_l"]).select("token", "word", "df").distinct()
    scored = pairs.withColumn("dist", text.osa_distance("token", "word"))
    budget = F.when(F.length("token") <= 5, 1).otherwise(2)
    ok = scored.where((F.col("dist") <= budget) & ~((F.col("dist") >= 2) & (F.length("token") != F.length("word"))))
    first = (F.substring("token", 1, 1) == F.substring("word", 1, 1)).cast("int")
    order = Window.partitionBy("token").orderBy("dist", F.desc(first), F.desc("df"), "word")
    return ok.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("token", "word", "dist")


def canonical(word: Column, synonyms: dict[str, str]) -> Column:
    """Synonym and stem, twice (O-STR-16)."""
    known = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    step = lambda c: text.stem(F.coalesce(F.try_element_at(known, c), c))
    return step(step(word))


def distinct_labels(labels: Column, most: int = 3, overlap: float = 0.6) -> Column:
    """Labels that share less than ``overlap`` of their words with every earlier kept one (O-WIN-13)."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    alike = lambda a, b: F.size(F.array_intersect(words(a), words(b))) >= overlap * F.least(F.size(words(a)), F.size(words(b)))
    return F.aggregate(labels, F.array().cast("array<string>"), lambda kept, x: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: alike(k, x)), kept).otherwise(F.array_append(kept, x)))


def guard_reasons(question: Column) -> Column:
    """Why a question about other people's records is declined; empty if it is not (O-CLS-6)."""
    low = F.lower(question)
    money = low.rlike(r"\b(salary|salaries|ctc|pay|payout|bonus|rating|leave balance|appraisal|compensation)\b")
    own = low.rlike(r"\b(my|mine|me|i|i'm|am i)\b")
    flags = {
        "aggregate": money & low.rlike(r"\b(average|median|percentile|mean|total|highest|lowest|everyone|all employees)\b"),
        "comparative": money & low.rlike(r"\b(compared? (to|with)|more than|less than|than (my|the) (team|peers?|colleagues?)|peers)\b"),
        "identifying": low.rlike(r"\b(who (is|are|has|have|got|earns?)|which employees?|list of employees)\b") & money,
        "third-party": money & ~own & (low.rlike(r"\b(his|her|their|manager's|colleague's|employee)\b") | question.rlike(r"\b[A-Z][a-z]+ [A-Z][a-z]+(?:'s)?\b")),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]))


def sensitive(corrected: Column, raw: Column) -> Column:
    """Whether a message reports misconduct; mistreatment must stand in the raw text (O-CLS-3)."""
    harm = r"\b(harass\w*|bull(y|ied|ying)|abus\w+|assault\w*|discriminat\w+|threaten\w*|molest\w*)\b"
    authority = r"\b(manager|boss|supervisor|lead|director|head|hr)\b"
    mistreat = r"\b(shout\w*|yell\w*|insult\w*|humiliat\w*|mistreat\w*|misbehav\w*|touch\w*)\b"
    return raw.rlike(harm) | (corrected.rlike(harm) & corrected.rlike(r"\b(me|my|i)\b")) | (corrected.rlike(authority) & raw.rlike(mistreat))


def stated(question: Column) -> dict[str, Column]:
    """Parameters in a question (O-CLS-5): rating 1 to 5, achievement up to 200 %, grade level up to 99, target amount."""
    number = lambda p: F.regexp_extract(F.lower(question), p, 1).try_cast("decimal(18,4)")
    rating, share, level = number(r"\brating\s*(?:of|is|=|:)?\s*([1-5])\b"), number(r"\b([0-9]{1,3}(?:\.[0-9]+)?)\s*(?:%|percent)"), number(r"\b(?:grade|level|l)\s*-?\s*([0-9]{1,2})\b")
    target = text.amount(F.regexp_extract(F.lower(question), r"\b(?:target|variable|ctc)\D{0,20}([0-9][0-9,.]*\s*(?:lakhs?|lacs?|crores?|cr|k|million|m)?)\b", 1))
    return {"rating": rating, "achievement": F.when(share <= 200, share), "level": level, "target": target}


def turn_kind(message: Column, offered: Column, asked_consent: Column) -> Column:
    """What a turn does in the dialogue, from the message and the state before it (O-CLS-7)."""
    low = F.lower(F.trim(message))
    yes, no = low.rlike(r"^(yes|yeah|yep|sure|ok(ay)?|please do|go ahead)\b"), low.rlike(r"^(no|nope|not now|don't|do not)\b")
    return (
        F.when(asked_consent & yes, "consent_given").when(asked_consent & no, "consent_refused").when(offered & low.rlike(r"^([1-5]|first|second|third|option [1-5])\b"), "choice")
        .when(low.rlike(r"^(hi|hello|hey|good (morning|afternoon|evening))\b"), "greeting").when(low.rlike(r"\b(thanks|thank you|thx)\b"), "thanks")
        .when(low.rlike(r"\b(talk|speak|connect)( me)? (to|with) (a |an )?(human|person|agent|hr|someone)\b|\braise a ticket\b"), "escalation").when(low.rlike(r"^(and|also|what about|how about)\b"), "follow_up").otherwise("knowledge")
    )


def routed(tickets: DataFrame) -> DataFrame:
    """Where a ticket goes; unknown routes give none (O-RUL-7). Columns: sensitive boolean, route string."""
    known = F.col("route").isin("none", "hr_ops", "hrbp", "hr_head")
    target = F.when(~F.coalesce(known, F.lit(False)), F.lit(None)).when(F.col("sensitive"), F.when(F.col("route") == "hr_head", "hr_head").otherwise("hrbp")).when(F.col("route") == "none", "hr_ops").otherwise(F.col("route"))
    return tickets.withColumns({"target": target, "priority": F.when(F.col("sensitive"), "critical").otherwise("normal"), "confidential": F.col("sensitive")})


def migrated_roles(roles: Column, retired: list[str], expanded: dict[str, list[str]]) -> Column:
    """Role arrays without the retired ones and with single permissions unfolded (O-CLS-9)."""
    kept = F.filter(roles, lambda r: ~r.isin(*retired))
    for one, many in expanded.items():
        kept = F.when(F.array_contains(kept, one), F.array_union(F.array_remove(kept, one), F.array(*[F.lit(m) for m in many]))).otherwise(kept)
    return kept
