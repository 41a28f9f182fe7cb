"""What a message is about: misconduct, figures that it states, and what to do with it.

Operators: O-CLS-2, O-CLS-3, O-CLS-5, O-WIN-13. Everything is an expression over columns; ``corrected`` joins distinct words to a
vocabulary and ``decide`` keeps one list per question of at most as many entries as there are intents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import kept
from . import classify

# Fixed values.
PROTECTED = r"\b(religion|religious|caste|race|racial|ethnic|ethnicity|gender|sexual|disability|disabled|orientation|marital|pregnan\w*|nationality)\b"
MISTREATED = r"\b(singled|unfair\w*|different\w*|denied|deny|excluded?|bias\w*|prejudice\w*|favourit\w*|favorit\w*|targeted|mock\w*|insult\w*|slur\w*|remarks?|comments?|overlooked|humiliat\w*|belittl\w*|passed\s+over)\b"
HARASSING_ACT = r"\b(assault\w*|molest\w*|stalk\w*|inappropriate\s+(touch\w*|behaviou?r|advances?|messages?)|touched\s+me|unsafe)\b"
HARASSMENT_TOPIC = r"\b(harass\w*|discriminat\w*|posh)\b"
OWN_ACCOUNT = (
    r"\b(i\s+am|i'm|im\s|i\s+was|i\s+have|i\s+feel|i\s+faced|i\s+(?:want|need|wish)\s+to\s+|happened\s+to\s+me|against\s+me|about\s+me|harass\w*\s+me|touch\w*\s+me"
    r"|my\s+(manager|lead|boss|supervisor|colleague|coworker|co-worker|teammate|senior|hod|team)|report\w*|complain\w*|victim|witness\w*|experienc\w*|suffer\w*|facing)\b"
)
#: Openings that ask and tell nothing; what starts so is no account.
ASKING = r"\b(i\s+am\s+(?:looking|searching|trying)|i\s+(?:want|need|wish)\s+to\s+(?:know|read|understand|see|learn|check|find))"
AUTHORITY = r"\b(manager|supervisor|boss|reporting|lead|leader|senior|hod|teammate|colleague|coworker|co-worker|team)\b"
GRIEVANCE = r"\b(grievance\w*|complaint\w*|complain\w*)\b"
ABUSE = r"\b(threat\w*|bully\w*|bullied|abus\w*|shout\w*|yell\w*|scream\w*|insult\w*|humiliat\w*|retaliat\w*|intimidat\w*|hostile|toxic|verbally)\b"
MISCONDUCT = (
    r"\b(cheat\w*|steal\w*|stole|stolen|theft|thief|fraud\w*|embezzl\w*|bribe\w*|briber\w*|kickback|forge\w*|forged|falsif\w*|fabricat\w*|fak(e|ed|ing)|misappropriat\w*|misconduct|malpractice|corrupt\w*"
    r"|conflict\s+of\s+interest|insider\s+trading|leak\w*)\b"
)
THIRD_PARTY = r"\b(someone|some\s?one|somebody|anyone|colleague|coworker|co-worker|teammate|manager|supervisor|boss|lead|employee|staff|team|vendor|contractor)\b"
REPORTING = r"\b(report\w*|complain\w*|whistle\s?blow\w*|escalate|raise|inform|tell\s+(hr|someone))\b"
SENSITIVE_ROUTES = {"sensitive_harassment": "hr_head", "sensitive_grievance": "hrbp", "sensitive_misconduct": "hr_head"}
ACHIEVEMENT = r"(?i)([0-9]{1,3}(?:\.[0-9]{1,2})?)\s*(?:%|percent|per cent|pc\b)"
GRADE, GRADE_MANAGER = r"(?i)\b[lx]\s?([0-9]{1,2})\b|\b(?:grade|level|band)\s*[:=]?\s*([0-9]{1,2})\b", r"(?i)\b[lx]\s?[0-9]{1,2}\b\s*(?:manager|mgr)"
VARIABLE_TARGET = r"(?i)\b(?:variable(?:\s+pay|\s+component)?|vpay|target|incentive|bonus)\b[^0-9?]{0,24}(?:rs\.?|inr|₹)?\s*([0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s*(lakhs?|lacs?|crores?|cr|k)?\b"
RATING_NUMBER = r"(?i)\b(?:rating|rated|rate)\s*(?:of|is|was|:|=)?\s*([1-5])\b|\b([1-5])\s*[-–]?\s*(?:rating|star)\b"
RATING_LABEL, RATING_CONTEXT = r"(?i)\b(outstanding|exceeds|meets|below|poor)\b", r"(?i)\b(rating|rated|appraisal|review)\b"
RATING_WORDS = {"outstanding": 5, "exceeds": 4, "meets": 3, "below": 2, "poor": 1}
MOST_SHARE, MOST_LEVEL, LEAST_TARGET, MOST_OPTIONS, ALIKE = 200, 99, 1000, 3, 0.6
# End of fixed values.


def sensitive_kind(corrected: Column, raw: Column) -> Column:
    """``struct<intent, hard>``, or null: what a message reports (O-CLS-3). Both columns hold normalised text.

    Acts and subjects are looked for in both spellings; mistreatment by someone in authority in the raw one alone, so that no
    spelling fix files an incident. ``hard`` is false where only the subject is named: it is answered, and the route offered.
    """
    either = lambda p: F.coalesce(corrected.rlike(p), F.lit(False)) | F.coalesce(raw.rlike(p), F.lit(False))
    own = lambda c: F.coalesce(F.regexp_replace(c, ASKING, "~").rlike(OWN_ACCOUNT), F.lit(False))
    acts, topic = either(HARASSING_ACT) | (either(PROTECTED) & either(MISTREATED)), either(HARASSMENT_TOPIC)
    mistreated = F.coalesce(raw.rlike(MISTREATED) | raw.rlike(ABUSE), F.lit(False))
    kind = lambda name, hard: F.struct(F.lit(name).alias("intent"), F.lit(hard).alias("hard"))
    return (
        F.when(acts | (topic & (own(corrected) | own(raw))), kind("sensitive_harassment", True)).when(either(GRIEVANCE) | (either(AUTHORITY) & mistreated), kind("sensitive_grievance", True))
        .when(either(MISCONDUCT) & (either(THIRD_PARTY) | either(REPORTING)), kind("sensitive_misconduct", True)).when(topic, kind("sensitive_harassment", False))
    )


def route_of(intent: Column) -> Column:
    """Where a sensitive intent goes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SENSITIVE_ROUTES.items() for x in kv]), intent)


def corrected(messages: DataFrame, vocabulary: DataFrame, key: str, most_words: int = 40) -> DataFrame:
    """``key, raw, corrected``: normalised messages, and with unknown words replaced by the nearest of a vocabulary (word, df).

    Messages of more than ``most_words`` words are prose and stay as they are, so no group below holds more than that many rows. Null texts are empty.
    """
    plain = kept(messages.select(key, text.normalize(F.col("text")).alias("raw")), "plain")  # read three times below
    words = plain.select(key, F.split("raw", " ").alias("w")).where(F.size("w") <= most_words).select(key, F.posexplode("w").alias("pos", "token"))
    words = words.where(F.col("token") != "")
    fixed = classify.spelled(words.where(~F.col("token").isin(*text.STOP_WORDS)).select("token"), vocabulary).select("token", "word")
    met = words.join(fixed, "token", "left").groupBy(key).agg(F.bool_or(F.col("word").isNotNull()).alias("any"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", "token").alias("w")))).alias("ws"))
    mended = met.where("any").select(key, text.phrased(F.array_join(F.transform("ws", lambda x: x["w"]), " ")).alias("mended"))
    return plain.join(mended, key, "left").select(key, "raw", F.coalesce("mended", "raw").alias("corrected"))


def stated(question: Column) -> dict[str, Column]:
    """Figures in a question (O-CLS-5): rating, achievement, grade level, target; null where there is none or it is out of range."""
    first_group = lambda c, p: F.concat(F.regexp_extract(c, text.plain_edges(p), 1), F.regexp_extract(c, text.plain_edges(p), 2)).try_cast("int")  # noqa: E731  one of two alternatives
    share = F.regexp_extract(question, text.plain_edges(ACHIEVEMENT), 1).try_cast("decimal(18,4)")
    # A level right before "manager" names a post.
    level = first_group(F.regexp_replace(question, text.plain_edges(GRADE_MANAGER), "~"), GRADE)
    aim = text.plain_edges(VARIABLE_TARGET)
    unit, number = F.lower(F.regexp_extract(question, aim, 2)), F.regexp_replace(F.regexp_extract(question, aim, 1), ",", "").try_cast("decimal(18,4)")
    factor = F.when(F.startswith(unit, F.lit("l")), 100000).when(F.startswith(unit, F.lit("cr")), 10000000).when(F.startswith(unit, F.lit("k")), 1000).otherwise(1)
    target = (number * factor).cast("decimal(18,4)")
    digit = first_group(question, RATING_NUMBER)
    word = F.lower(F.regexp_extract(question, text.plain_edges(RATING_LABEL), 1))
    named = F.when(question.rlike(text.plain_edges(RATING_CONTEXT)), reduce(lambda c, kv: c.when(word == kv[0], kv[1]), RATING_WORDS.items(), F.when(F.lit(False), 0)))
    return {"rating": F.coalesce(digit, named), "achievement": F.when(share <= MOST_SHARE, share), "level": F.when(level <= MOST_LEVEL, level), "target": F.when(target >= LEAST_TARGET, target)}


def stated_in_turns(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """User turns with each figure of the turn itself or else the newest one of an earlier user turn."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = turns.where("role = 'user'").select(by, order, *[c.alias(n) for n, c in stated(F.col("text")).items()])
    return own.select(by, order, *[F.last(n, ignorenulls=True).over(so_far).alias(n) for n in ("rating", "achievement", "level", "target")])


def _options(ranked: Column) -> Column:
    """At most three labels of candidates over the offer threshold, none that shares most of its longer words with an earlier one."""
    kept = F.filter(ranked, lambda x: x["score"] > classify.OFFER)
    alike = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.filter(b, lambda w: F.array_contains(a, w))) >= ALIKE * F.least(F.size(a), F.size(b)))
    none = F.array().cast("array<struct<intent:string,words:array<string>>>")
    step = lambda out, x: F.when((F.size(out) >= MOST_OPTIONS) | F.exists(out, lambda o: alike(o["words"], x["words"])), out).otherwise(F.array_append(out, F.struct(x["intent"].alias("intent"), x["words"].alias("words"))))
    return F.transform(F.aggregate(kept, none, step), lambda o: o["intent"])


def decide(questions: DataFrame, scored: DataFrame, labels: DataFrame, key: str = "item_id") -> DataFrame:
    """``key, decision, confidence, intent, route, options`` (O-CLS-2): one row per question.

    questions: key, kind (of ``sensitive_kind``), clarified boolean. scored: key, intent, score of the intents that may be asked for;
    a question without a row there holds no word to go by. labels: intent, label. Options are the intents that a clarifying question offers.
    """
    words = F.filter(F.split(F.lower("label"), "[^a-z]+"), lambda w: F.length(w) > 3)
    entry = F.struct((-F.col("score")).alias("_by"), F.col("intent").startswith("faq_").alias("_faq"), "intent", "score", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    ranked = scored.join(labels.select("intent", words.alias("words")), "intent", "left").groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    met = questions.select(key, "kind", "clarified").join(ranked, key, "left").withColumns({"top": F.get("ranked", F.lit(0)), "offered": _options(F.col("ranked"))})
    hard, top = F.coalesce(F.col("kind.hard"), F.lit(False)), F.col("top.score")
    enough = F.size("offered") >= 2
    decision = (
        F.when(hard, "sensitive").when(top.isNull() | (top < classify.ESCALATE), "escalate").when((top >= classify.ANSWER) | F.coalesce("clarified", F.lit(False)), "answer").when(enough, "clarify").otherwise("escalate")
    )
    met = met.withColumn("decision", decision)
    answered = F.col("decision").isin("answer", "clarify")
    return met.select(
        key, "decision", F.when(hard, 1.0).otherwise(F.coalesce(top, F.lit(0.0))).alias("confidence"), F.when(hard, F.col("kind.intent")).when(answered, F.col("top.intent")).alias("intent"),
        F.when(hard, route_of(F.col("kind.intent"))).when(answered, "none").otherwise("hr_ops").alias("route"), F.when(F.col("decision") == "clarify", F.col("offered")).alias("options"),
    )
