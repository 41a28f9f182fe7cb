import datetime

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text, values
from quillstream.operators import answers, chunking, classify


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("word, stem", [("applied", "apply"), ("running", "run"), ("leaves", "leav"), ("policies", "polic"), ("submitted", "submit"), ("falling", "fall"), ("pass", "pass"), ("children", "child"), ("boss", "boss")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem


def test_normalize_and_tokenize(spark):
    assert one(spark, text.normalize(F.lit("  What’s my  Time-off bal pls "))) == "what my leave balance please"
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, text.tokenize(F.lit("How many days off did I apply for?"))) == ["howmany", "leave", "apply"]


@pytest.mark.parametrize("a, b, d", [("peroid", "period", 1), ("abc", "abc", 0), ("ca", "abc", 3), ("", "ab", 2)])
def test_edit_distance(a, b, d):
    assert text.osa(a, b) == d


@pytest.mark.parametrize("said, amount", [("2.5 lakh", 250000), ("1,20,000", 120000), ("3 crore", 30000000), ("75k", 75000), ("999", None), ("none", None)])
def test_amount(spark, said, amount):
    got = one(spark, text.amount(F.lit(said)))
    assert (None if got is None else float(got)) == amount


def test_small_text_functions(spark):
    assert one(spark, text.title_of(F.lit("leave_policy-2024.md"))) == "Leave policy 2024"
    assert one(spark, text.slug(F.lit("--HR & Payroll Ops!"))) == "hr-payroll-ops"
    assert one(spark, text.clip(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, text.strip_tags(F.lit("<p>a &lt;b&gt; &amp;lt;</p>"))) == "a <b> &lt;"
    assert one(spark, text.account_of(F.lit("ann_x.io#EXT#@tenant.io"))) == "ann@x.io"
    assert one(spark, text.tidy_space(F.lit("a  \r\nb\n\n\n\nc "))) == "a\nb\n\nc"
    assert one(spark, text.bigrams(F.array(F.lit("a")))) == []
    assert one(spark, text.strip_citations(F.lit("Answer: yes [1, 2]."))) == "yes."
    assert [tuple(r) for r in one(spark, text.sse_frames(F.lit("event: token\ndata: a\ndata: b\n\nevent: done\ndata:x\n\n")))] == [("token", " a\n b"), ("done", "x")]


def test_values(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, values.tenure_months(day("2024-01-31"), day("2024-02-28"))) == 0
    assert one(spark, values.tenure(day("2020-01-15"), day("2022-02-15"))) == "2 years 1 month"
    assert one(spark, values.parse_day(F.lit("5-Mar-2024"))) == datetime.date(2024, 3, 5)
    assert one(spark, values.parse_day(F.lit("soon"))) is None
    assert one(spark, values.month_key(F.lit("March 2024"))) == "2024-03" and one(spark, values.month_key(F.lit("Q1"))) == "Q1"
    assert one(spark, values.indian_grouping(F.lit(1234567))) == "12,34,567"
    assert one(spark, values.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, values.rescaled(F.lit(0.57))) == pytest.approx(0.5)
    assert one(spark, values.base36(F.lit(1295))) == "zz"
    import uuid, hashlib

    want = str(uuid.UUID(bytes=hashlib.md5(b"doc#1").digest(), version=3))
    assert one(spark, values.name_uuid(F.lit("doc#1"))) == want


def test_chunking(spark):
    doc = "# A\nintro text here\n### C\n" + "\n\n".join(f"Paragraph {i} has some words. " * 12 for i in range(8)) + "\n# B\n\n# D\nlast part"
    parts = list(chunking.sections(doc))
    assert [p[0] for p in parts] == [["A"], ["A", "C"], ["D"]]
    pieces = chunking.split(parts[1][1])
    assert len(pieces) > 1 and all(len(p) <= 1400 + 400 for p in pieces)
    assert chunking.overlap("1 2\n3 4\n" * 60) == ""
    rows = chunking.chunk(spark.createDataFrame([(1, doc), (2, None), (3, "??")], "doc_id long, text string")).orderBy("doc_id", "idx").collect()
    assert rows[0].id == "1#0" and [r.idx for r in rows if r.doc_id == 1] == list(range(len(rows) - 1)) and rows[-1].body == "??"


def test_answer_rules(spark):
    mode = lambda c, g=False, d=False: one(spark, answers.mode(F.lit(c), F.lit(g), F.lit(d)))
    assert [mode(0.33), mode(0.34), mode(0.9, True), mode(0.9, d=True)] == ["none", "extractive", "generated", "declined"]
    took = lambda a, b, bare=False: one(spark, answers.retried(F.lit(a), F.lit(b), F.lit(bare)))
    assert [took(0.2, 0.5), took(0.2, 0.3), took(0.4, 0.5), took(0.4, 0.5, True), took(0.5, 0.4, True)] == [True, False, False, True, False]
    assert one(spark, answers.refusal(F.lit("Sorry, I could not find that."))) and not one(spark, answers.refusal(F.lit("You have 12 days.")))
    assert one(spark, answers.label(F.lit("T"), F.array(F.lit("a"), F.lit(" "), F.lit("b")))) == "T › a › b"


@pytest.mark.parametrize(
    "said, reasons",
    [("What is my salary?", []), ("What is the average salary here?", ["aggregate"]), ("What is Jane Miller's salary?", ["third-party"]), ("Who has the highest bonus?", ["aggregate", "identifying"]), ("How do I apply for leave?", []), ("Is my pay less than my peers?", ["comparative"])],
)
def test_guard(spark, said, reasons):
    assert one(spark, classify.guard_reasons(F.lit(said))) == reasons


def test_classifier_rules(spark):
    assert one(spark, classify.sensitive(F.lit("my manager shouted at me"), F.lit("my manager shouted at me")))
    assert not one(spark, classify.sensitive(F.lit("who is my manager"), F.lit("who is my manager")))
    p = classify.stated(F.lit("with rating 4, grade 7, 95% and a target of 2 lakh"))
    assert [float(one(spark, p[k])) for k in ("rating", "level", "achievement", "target")] == [4, 7, 95, 200000]
    kinds = [one(spark, classify.turn_kind(F.lit(m), F.lit(True), F.lit(False))) for m in ("Hello", "2", "thanks!", "talk to a human", "what about sick leave", "explain gratuity")]
    assert kinds == ["greeting", "choice", "thanks", "escalation", "follow_up", "knowledge"]
    assert one(spark, classify.distinct_labels(F.array(*map(F.lit, ["sick leave", "sick leave rules", "pay slip", "tax", "late"])))) == ["sick leave", "pay slip", "tax"]
    assert one(spark, classify.migrated_roles(F.array(F.lit("old"), F.lit("x")), ["old"], {"x": ["y", "z"]})) == ["y", "z"]


def test_word_edges_as_sql_reads_them(spark):
    """Letters with accents end a word, as in DuckDB, whatever Java's version."""
    import duckdb

    from quillstream.operators import classify, privacy

    said = ["épfé", "my pf", "pfx", "élos", "los élos", "in\nhand", "in-hand", "why?\u2028", "why?\n", "why?\x0b", "why? ", "ü leaveé", None]
    flags = {"has": r"\b(the|los|les|die)\b", "asks": r"\?\s*$", "in": r"a[\s-]?b|in.?hand"} | privacy.FIELD_WORDS
    rows = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    got = {r.i: r.f for r in rows.select("i", classify.fields_of(F.col("text"), flags).alias("f")).collect()}
    for i, s in enumerate(said):
        assert got[i] == ",".join(n for n, p in flags.items() if duckdb.execute("select regexp_matches(?::varchar, ?)", [s, p]).fetchone()[0])
    assert "compensation" in got[0]


def test_passages_leave_in_small_batches():
    """Whatever a batch of texts holds, its passages go on by ``HELD`` characters, none lost and numbered as before."""
    import pyarrow as pa

    long = "\n\n".join(f"# Part {i}\n" + f"Sentence {i} has words. " * 60 for i in range(2_000))
    texts = ["short text", None, "??", "", long, "last one"]
    made = list(chunking._rows(iter([pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])])))
    assert len(made) > 2 and max(sum(len(b) for b in m.column(3).to_pylist()) for m in made) < 1.1 * chunking.HELD
    rows = [tuple(r.values()) for m in made for r in m.to_pylist()]
    want = [(4, headings, piece) for headings, body in chunking.sections(long) for piece in chunking.split(body)]
    assert [(d, h, p) for d, _, h, p in rows if d == 4] == want and [i for d, i, _, _ in rows if d == 4] == list(range(len(want)))
    assert [r for r in rows if r[0] != 4] == [(0, 0, [], "short text"), (2, 0, [], "??"), (5, 0, [], "last one")]
