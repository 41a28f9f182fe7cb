"""Whose record a question reaches for: the asker's own fields, carried over turns, and other people's data.

Operators: O-CLS-4, O-CLS-6, O-SET-4. Rules are ``Column`` expressions over fixed patterns. People of a directory are found in texts by one pass of an
automaton where the directory is measured to be small, else by a join on word grams; both find the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_edges

# The words that name a field of a personal record, in the order in which fields are listed.
FIRST_PERSON = r"\b(my|mine|me|i|i'm|im|iam|i am|myself)\b"
ELLIPTICAL = (
    r"^\s*(?:(?:tell|show|give|get|display|fetch|find|print)\s+(?:me\s+)?(?:the\s+)?(?:name|full name|employee code|emp code|employee id|emp id|empid|employee number|emp number|staff id|details|record|profile|designation|grade)\b"
    r"|(?:name|full name|employee code|emp code|employee id|emp id|empid|employee number|emp number|staff id|details|profile)\s*[?.!]*\s*$)"
)
IDENTITY = (
    r"\b(employee code|emp code|employee id|emp id|empid|employee number|emp number|employee no|emp no|staff id|associate id|payroll number|my id|my code|my name|my full name|my legal name|name on record|who am i|whoami"
    r"|my details|my profile|my record|my records|my information|my info|my data|about myself)\b"
)
FIELD_WORDS = {
    "employment": r"\b(grade|designation|title|role|band|business unit|bu|department|function|location|manager|reporting|l2|hrbp|hr business partner|joining|doj|date of joining|tenure|probation|confirm|confirmation|employment status|notice period)\b",
    "compensation": r"\b(ctc|salary|compensation|package|fixed pay|gross|monthly|take home|in.?hand|breakdown|earnings|hra|house rent|basic|special allowance|allowance|provident fund|\bpf\b|professional tax|\bptax\b|gratuity|deduction|deductions|structure|components?)\b",
    "variable_pay": r"\b(variable|vpay|incentive|bonus|payout|commission|target achievement|achievement|achieve|achieved|achieving|attain|attained|matrix|quota|revenue|grr|company performance|company result|company targets)\b",
    "leave": r"\b(leave|leaves|holiday|vacation|earned|el\b|sick|sl\b|casual|cl\b|maternity|paternity|encash|carry forward|balance)\b",
    "attendance": r"\b(attendance|present|absent|wfh|work from home|days worked|swipe|late marks?)\b",
    "pms": r"\b(pms|appraisal|performance|rating|review cycle|last cycle|kra|kpi)\b",
}
COMPUTATION = (
    r"\b(what will i get|what would i get|how much will i|how much would i|compute|calculate|work out|if i achieve|if i hit|based on|expected payout|projected|what will my|what would my|what is my payout|whats my payout"
    r"|how much variable|how much payout|payout be|payout will be|do i get)\b"
)
CONTINUATION = r"^\s*(and|so|then|also|but|ok|okay|what about|how about)\b|\bwhat about\b|\bhow about\b"
STATED_SHARE = r"\d{1,3}(?:\.\d{1,2})?\s*(?:%|percent|per cent|pc\b)"
STATED_OTHER = r"\brating\s*(?:of|is|=|:)?\s*[1-5]\b|\b(?:grade|level|l)\s*-?\s*[0-9]{1,2}\b|\b(?:target|variable|ctc)[^0-9]{0,20}[0-9][0-9,.]*"


def _low(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit("")))


def vocabulary_fields(question: Column) -> Column:
    """The fields whose words a question holds, in fixed order."""
    low = _low(question)
    held = {name: low.rlike(plain_edges(words)) for name, words in FIELD_WORDS.items()}
    held["employment"] |= low.rlike(plain_edges(IDENTITY)) | low.rlike(plain_edges(ELLIPTICAL))
    held["variable_pay"] |= low.rlike(plain_edges(COMPUTATION))
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in held.items()]))


def own_fields(question: Column) -> Column:
    """The same for questions about the asker: in the first person, elliptical, or about variable pay."""
    low, fields = _low(question), vocabulary_fields(question)
    return F.when(low.rlike(plain_edges(FIRST_PERSON)) | low.rlike(plain_edges(ELLIPTICAL)) | F.array_contains(fields, "variable_pay"), fields).otherwise(F.array().cast("array<string>"))


def with_fields(turns: DataFrame, key: str = "conv_id", order: str = "turn", question: str = "text") -> DataFrame:
    """User turns with ``fields``: their own and, for a continuation, those of the newest earlier turn that has any.

    A turn that supposes a rating, grade or target adds the earlier fields to its own; a turn that names fields without asking
    about the asker inherits nothing. The earlier set is a running last value, one pass over each conversation.
    """
    none = F.array().cast("array<string>")
    rows = turns.where("role = 'user'").withColumns({"_own": own_fields(F.col(question)), "_any": vocabulary_fields(F.col(question))})
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.size("_own") > 0, F.col("_own")), ignorenulls=True).over(earlier)
    low = _low(F.col(question))
    supposes = low.rlike(plain_edges(STATED_OTHER))
    follows = low.rlike(plain_edges(CONTINUATION)) | low.rlike(plain_edges(COMPUTATION)) | low.rlike(plain_edges(STATED_SHARE)) | supposes
    inherits = follows & (supposes | (F.size("_any") == 0))
    return rows.withColumn("_prior", prior).withColumn("fields", F.when(inherits, F.array_union("_own", F.coalesce("_prior", none))).otherwise(F.col("_own"))).drop("_own", "_any", "_prior")


# What reaches for another person's record.
PERSONAL = (
    r"\b(ctc|salary|salaries|compensation|pay|payroll|payout|package|increment|bonus|variable|incentive|incentives|earn|earns|earner|earners|earning|earnings|paid|hra|house rent|basic|special allowance|provident fund|\bpf\b"
    r"|professional tax|gratuity|grade|designation|band|leave balances?|balances?|leaves? left|attendance|rating|ratings|appraisal|performance|pms|tenure|joining date|probation|manager|reportee|reporting to|employee (?:id|code)|offer)\b"
)
EMPLOYEE_CODE = r"\b(?:ls|emp|lsq)[-_ ]?\d{3,}\b"
THIRD_PARTY = (
    r"\b(his|her|their|theirs|hers|someone|somebody|anyone|anybody|colleague|coworker|co-worker|teammate|team ?mate|everyone|everybody|other (?:employees?|people)|another (?:employee|person)"
    r"|(?:my )?(?:manager|boss|lead|reportee|peer)'s|person who|employee who|people who)\b"
)
COMPARATIVE = r"\b(richest|best paid|highest[- ]paid|top[- ]earner|rank|ranked|ranking|compare|comparison|versus|vs\.?|than (?:me|mine)|more than i|less than i|who (?:earns|makes|gets|is paid))\b"
SUPERLATIVE = r"\b(highest|lowest|top|bottom|most|least|maximum|minimum|max|min)\b"
AGGREGATE = r"\b(average|avg|mean|median|headcount|distribution|spread|percentile|how many (?:people|employees)|everyone(?:'s)?|everybody(?:'s)?|team's (?:total|average)|across the (?:team|department|bu)|payroll (?:of|for|in)|sum of|combined (?:ctc|salary|salaries|pay))\b"
SUM_OF_PAY = r"\btotal (?:payroll|salary|salaries|ctc|pay|compensation|comp|cost)\b"
PEOPLE_SET = r"\b(team|teams|department|departments|bu|business unit|everyone|everybody|all employees|employees|colleagues|peers|others|reportees|people|anyone)\b"
PEOPLE_SCOPE = r"\b(team|teams|department|departments|bu|business unit|company|org|organisation|organization|everyone|everybody|all employees|colleagues|peers|others|reportees|function|vertical|grade|band|office|location)\b"
IMPERSONATION = r"\b(if i (?:were|was)|pretend|role[- ]?play|act as|acting as|you are now|on behalf of|impersonat\w*|for (?:training|testing|demo|research) purposes|ignore (?:the|your|all) (?:rules?|instructions?|restrictions?))\b"
ROLE_OF = (
    r"\b(?:of|for|about)\s+(?:my|our|his|her|their|the)\s+(?:reporting\s+|line\s+|l2\s+|skip[- ]level\s+|direct\s+)?(manager|boss|supervisor|hrbp|function head|bu head|team lead|reportee|report)\b"
    r"|\b(?:my|our|his|her|their|the)\s+(?:reporting\s+|line\s+|l2\s+|skip[- ]level\s+|direct\s+)?(?:manager|boss|supervisor|hrbp|function head|bu head|team lead|reportee)\b[^.?]{0,15}?\b(?:earn|earns|earning|make|makes|paid|salary|ctc|compensation)\b"
)
GRADE_OR_BAND = r"\b(l\d{1,2}|band|grade|level|designation)\b"
IDENTIFYING = r"\b(who joined|who reports|reporting to me|in my team|on my team|in my bu|in my department|under me|my team member|my direct reports?\b|my directs)\b"
POSSESSIVE = r"\b([a-z][a-z.'-]{2,})'s\b"
PROPER_POSSESSIVE, PROPER_OBJECT = r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)?)'s\b", r"\b(?:of|for|about)\s+([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*)\b"
# Owners that are no persons, first by grammar, then by trade.
NO_PERSON = """my mine our ours your yours the this that its it company companies organisation organization org employer team teams department departments bu hr leadsquared today yesterday tomorrow month year quarter week
 everyone everybody someone somebody anyone nobody india government employee employees what who where when how why there here let one all something nothing anything everything he she they we you""".split()
TRADE_WORDS = """net new gross total basic special house rent allowance provident fund professional tax variable fixed target actual payout slab slabs band bands grade grades level tier plan policy scheme bonus incentive commission gratuity
 encashment reimbursement relocation brokerage salary compensation ctc payroll deduction contribution increment appraisal promotion sales marketing engineering finance product support success presales operations revenue bookings retention churn quota
 achievement attainment pipeline renewal upsell earned casual sick maternity paternity bereavement sabbatical notice probation confirmation resignation separation onboarding insurance mediclaim coverage america american europe emea apac singapore dubai
 bengaluru bangalore mumbai noida hyderabad chennai delhi gurgaon pune january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday annual monthly quarterly fiscal
 financial half full section clause annexure appendix schedule exhibit table terms conditions handbook manual""".split()


def _person(name: Column) -> Column:
    known = F.array(*[F.lit(w) for w in NO_PERSON + TRADE_WORDS])
    return ~F.arrays_overlap(F.split(F.lower(name), r"\s+"), known)


def decline_reasons(question: Column, named: Column | None = None) -> Column:
    """Why a question is declined, in order of the rules; empty if it is not (O-CLS-6). ``named``: whether it names a person of the directory."""
    raw, low = F.coalesce(question, F.lit("")), _low(question)
    matches = lambda pattern, text=low: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    by_name = F.exists(matches(PROPER_POSSESSIVE, raw), _person) | F.exists(matches(PROPER_OBJECT, raw), _person) | F.exists(matches(POSSESSIVE), _person)
    if named is not None:
        by_name = by_name | F.coalesce(named, F.lit(False))
    only = lambda reason: F.array(F.lit(reason))
    aggregate = low.rlike(AGGREGATE) | (low.rlike(SUM_OF_PAY) & low.rlike(PEOPLE_SCOPE))
    compared = low.rlike(COMPARATIVE) | (low.rlike(SUPERLATIVE) & (low.rlike(PEOPLE_SET) | low.rlike(THIRD_PARTY)))
    identified = low.rlike(IDENTIFYING)
    third = low.rlike(THIRD_PARTY) & (aggregate | compared | identified | ~low.rlike(GRADE_OR_BAND))  # a band alone is a question about policy
    flags = {"aggregate": aggregate, "comparative": compared, "identifying_predicate": identified, "third_party": third}
    listed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]))
    return (
        F.when(low.rlike(EMPLOYEE_CODE), only("named")).when(~low.rlike(PERSONAL), F.array().cast("array<string>")).when(by_name, only("named"))
        .when(low.rlike(IMPERSONATION) | low.rlike(ROLE_OF), only("third_party")).otherwise(listed)
    )


# ---- people of a directory ----

WORD = "[^a-z0-9à-öø-ÿ]+"
MOST_NAMES, MOST_CHARS = 200_000, 8_000_000  # of a directory that is broadcast


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(_low(text), WORD, " "))


def _found_by_automaton(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for name in names:
            machine.add_word(f" {name} ", name)
        machine.make_automaton()
        for batch in batches:
            found = [sorted({name for _, name in machine.iter(f" {text} ")}) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["key", "names"])

    return run


def people_named(texts: DataFrame, directory: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name", small: bool | None = None, most_words: int | None = None) -> DataFrame:
    """``key, name``: which names of the directory stand in a text as whole words, letter case and punctuation aside.

    The directory is measured: up to ``MOST_NAMES`` names of ``MOST_CHARS`` characters go to every task as one automaton, a larger one is joined
    on the word grams of the lengths that names have. Null keys, texts and names name nobody. With ``most_words``, only names of so
    many words count, once punctuation has parted them.
    """
    names = directory.select(_plain(F.col(name)).alias("name")).where("name <> ''").distinct()
    if most_words is not None:
        names = names.where(F.size(F.split("name", " ")) <= most_words)
    if small is None:
        size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars")).first()
        small = size.n <= MOST_NAMES and size.chars <= MOST_CHARS
    plain = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), _plain(F.col(text)).alias("plain"))
    if small:
        listed = [r.name for r in names.collect()]
        if not listed:
            return plain.select(F.col("key").alias(key), F.lit("").alias("name")).limit(0)
        found = plain.mapInArrow(_found_by_automaton(listed), "key long, names array<string>")
        return found.select(F.col("key").alias(key), F.explode("names").alias("name")).distinct()
    sized = names.withColumn("n", F.size(F.split("name", " ")))
    lengths = [r.n for r in sized.select("n").distinct().collect()]  # words in a name: a handful
    words = F.split("plain", " ")

    def grams_of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.array(*[grams_of(n) for n in lengths])))
    return plain.select("key", F.explode(grams).alias("name")).join(sized.select("name"), "name").select(F.col("key").alias(key), "name").distinct()
