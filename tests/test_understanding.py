"""Misconduct, stated figures and the decision, by stated examples."""

from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.operators import understanding

KINDS = {
    "my manager is threatening me": ("sensitive_grievance", True), "My lead shouts at me": ("sensitive_grievance", True), "i want to report harassment": ("sensitive_harassment", True), "Tell me about posh policy?": ("sensitive_harassment", False),
    "what is posh?": ("sensitive_harassment", False), "I want to know about harassment": ("sensitive_harassment", False), "i am looking for the harassment policy": ("sensitive_harassment", False), "i am being harassed": ("sensitive_harassment", True),
    "He touched me": ("sensitive_harassment", True), "Some one is cheating in office": ("sensitive_misconduct", True), "what does the policy say about fraud": None, "what is the religious holiday policy": None,
    "I was singled out for my religion": ("sensitive_harassment", True), "How much unpaid leave can I take": None, "Where is LeadSquared located": None, "who is my manager": None, "I have a complaint": ("sensitive_grievance", True), "": None,
}


def test_sensitive_examples(spark):
    rows = spark.createDataFrame([(q,) for q in KINDS] + [(None,)], "q string")
    rows = rows.select("q", text.normalize(F.col("q")).alias("raw"))
    got = {r.q: r.k and tuple(r.k) for r in rows.select("q", understanding.sensitive_kind(F.col("raw"), F.col("raw")).alias("k")).collect()}
    assert got == KINDS | {None: None}


def test_no_correction_files_an_incident(spark):
    pair = spark.createDataFrame([("my manager was unfair", "my manager was unpaid"), ("i have a grievance", "i have a grievence")], "fixed string, raw string")
    assert [r.k and r.k.intent for r in pair.select(understanding.sensitive_kind(F.col("fixed"), F.col("raw")).alias("k")).collect()] == [None, "sensitive_grievance"]


def test_spelling_of_typed_questions_only(spark):
    long = "manger " * 41
    rows = spark.createDataFrame([(1, "ask my manger"), (2, None), (3, long), (4, "manager"), (5, "")], "id long, text string")
    words = spark.createDataFrame([("manager", 3), ("leave", 1)], "word string, df int")
    got = {r.id: (r.raw, r.corrected) for r in understanding.corrected(rows, words, "id").collect()}
    assert got == {1: ("ask my manger", "ask my manager"), 2: ("", ""), 3: (long.strip(), long.strip()), 4: ("manager", "manager"), 5: ("", "")}


def test_stated_figures(spark):
    cases = {
        "If my variable pay is 10,000, what would I get?": (None, None, None, 10000), "how much of my 12 lakh CTC is variable": (None, None, None, None), "suppose my variable pay is 2 lakh": (None, None, None, 200000),
        "target 1.5 cr": (None, None, None, 15000000), "what if I'm rated 4": (4, None, None, None), "what is 4 months of variable pay": (None, None, None, None), "my appraisal was Outstanding": (5, None, None, None), "does this meet the policy": (None, None, None, None),
        "if I was at L8, what would I get?": (None, None, 8, None), "who is my L2 manager": (None, None, None, None), "at grade: 5 with 87.5%": (None, 87.5, 5, None), "at 210 percent": (None, None, None, None), "bonus 5": (None, None, None, None), None: (None,) * 4,
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q string")
    got = {r.q: (r.rating, None if r.achievement is None else float(r.achievement), r.level, None if r.target is None else float(r.target)) for r in rows.select("q", *[c.alias(n) for n, c in understanding.stated(F.col("q")).items()]).collect()}
    assert got == cases


def test_figures_carry_over(spark):
    turns = [(1, 0, "user", "my variable pay is 2 lakh"), (1, 1, "assistant", "at L9"), (1, 2, "user", "and at rating 5?"), (1, 3, "user", "variable pay of 3 lakh at L4"), (2, 0, "user", "and then?")]
    got = understanding.stated_in_turns(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.rating, r.level, r.target and int(r.target)) for r in got} == {(1, 0): (None, None, 200000), (1, 2): (5, None, 200000), (1, 3): (5, 4, 300000), (2, 0): (None, None, None)}


def test_decision(spark):
    kind = "struct<intent:string,hard:boolean>"
    asked = [(1, ("sensitive_grievance", True), False), (2, None, False), (3, None, False), (4, None, False), (5, None, False), (6, None, True), (7, ("sensitive_harassment", False), False), (8, None, False)]
    scored = [(1, "a", 0.9), (3, "a", 0.29), (4, "a", 0.6), (5, "a", 0.5), (5, "b", 0.45), (5, "c", 0.4), (5, "d", 0.2), (5, "e", 0.12), (6, "faq_a", 0.4), (6, "b", 0.4), (7, "b", 0.7), (8, "a", 0.5), (8, "b", 0.4)]
    labels = [("a", "Leave policy rules"), ("b", "The leave policy"), ("c", "Latest payslip"), ("d", "Car lease scheme"), ("e", "Notice period"), ("faq_a", "x")]
    got = understanding.decide(spark.createDataFrame(asked, f"item_id int, kind {kind}, clarified boolean"), spark.createDataFrame(scored, "item_id int, intent string, score double"), spark.createDataFrame(labels, "intent string, label string"))
    assert {r.item_id: (r.decision, r.confidence, r.intent, r.route, r.options) for r in got.collect()} == {
        1: ("sensitive", 1.0, "sensitive_grievance", "hrbp", None), 2: ("escalate", 0.0, None, "hr_ops", None), 3: ("escalate", 0.29, None, "hr_ops", None), 4: ("answer", 0.6, "a", "none", None),
        5: ("clarify", 0.5, "a", "none", ["a", "c", "d"]), 6: ("answer", 0.4, "b", "none", None), 7: ("answer", 0.7, "b", "none", None), 8: ("escalate", 0.5, None, "hr_ops", None),
    }
