import zipfile

from pyspark.sql import functions as F

from quillstream.functions import values
from quillstream.operators import access, metrics, search, store, tables
from quillstream.operators.knowledge import KnowledgeBase
from quillstream.sources import readers
from quillstream.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_details_keep_the_last_row(spark):
    master = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    pay = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (9, 5, 3)], "id int, ctc int, row int")
    joined = tables.with_details(master, "id", {"pay": (pay, "row")})
    assert [(r.id, r.pay and r.pay.ctc) for r in joined.orderBy("id").collect()] == [(1, 20), (2, None)]
    assert tuple(tables.reconciliation(joined, ["pay"]).first()) == (2, 1, 1)
    assert rows(tables.unknown(pay, master, "id")) == [(9, 5, 3)]


def test_register(spark):
    sheet = spark.createDataFrame([(1, "2024-01", "P", "L", "WO", "0.5P"), (2, "2024-01", "WO", "H", "", None)], "id int, month string, d1 string, d2 string, d3 string, d4 string")
    days = tables.unfolded(sheet, ["id", "month"], ["d1", "d2", "d3", "d4"])
    assert rows(tables.register(days, "id", "month", "code")) == [(1, "2024-01", 3, 2, 1)]


def test_store_rewrites(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert rows(store.upsert(old, new, "id"), "id") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.with_fallback(spark.createDataFrame([(1, " ")], "id int, v string"), old, "id", []), "id") == [(1, "a")]
    assert rows(store.with_fallback(spark.createDataFrame([(1, None)], "id int, v string"), old, "id", ["v"]), "id") == [(1, None)]
    versions = spark.createDataFrame([("f", "md", 1), ("f", "md", 2), ("g", "manual", 1), ("g", "manual", 2)], "file string, kind string, at int")
    assert rows(store.newest(versions, ["file", "kind"], ["at"], F.col("kind") == "manual"), "file", "at") == [("f", "md", 2), ("g", "manual", 1), ("g", "manual", 2)]


def test_visibility(spark):
    t = spark.createDataFrame([(1, "Ann@x.io", False), (2, "bob@x.io", True), (3, "bob@x.io", False)], "id int, raised_by string, confidential boolean")
    ids = lambda me, mine: [r.id for r in access.visible(t, me, mine).orderBy("id").collect()]
    assert ids(None, set()) == [1, 2, 3] and ids("ann@x.io", set()) == [1] and ids("ann@x.io", {access.QUEUE}) == [1, 3] and ids("ann@x.io", {access.QUEUE, access.SENSITIVE}) == [1, 2, 3]
    assert ids("bob@x.io", {access.QUEUE}) == [1, 2, 3]
    assert [access.clamp(x) for x in (None, 0, 5, 9999)] == [200, 200, 5, 1000]


def test_distinct_people_do_not_add_up(spark):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-02 10:00:00"), (2, "2024-01-02 11:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    days = metrics.daily(e, F.col("ts"), "user_id")
    total = metrics.windows(e, F.col("ts"), "user_id", "2024-01-01", "2023-12-01", "2024-02-01").first()
    assert days.agg(F.sum("people")).first()[0] == 3 and total.people == 2 and total.delta is None
    full = metrics.filled(days, "2024-01-01", "2024-01-03").orderBy("day").collect()
    assert [(r.label, r.messages) for r in full] == [("Mon", 1), ("Tue", 2), ("Wed", 0)]


def test_trailing_hour_excludes_its_edge(spark):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:59:59"), (1, "2024-01-01 11:00:00")], "u int, ts string")
    assert [r.recent for r in metrics.trailing_count(e, ["u"], "ts").orderBy("ts").collect()] == [1, 2, 2]


def test_diversified_fills_up(spark):
    s = spark.createDataFrame([(0, i, "a" if i < 6 else "b", 1.0 - i / 100) for i in range(8)], "question int, doc_id int, g string, score double")
    got = [r.doc_id for r in search.diversified(s, "g", k=4).orderBy("rank").collect()]
    assert got == [0, 1, 2, 6]
    assert [r.doc_id for r in search.diversified(s.where("g = 'a'"), "g", k=4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "leave_policy.md").write_bytes("﻿# Leave\n\nYou get twelve days of earned leave.\n".encode())
    (folder / "empty.txt").write_bytes(b"  \n")
    (folder / "x.exe").write_bytes(b"MZ")
    (folder / "bad.docx").write_bytes(b"not a zip")
    (folder / "broken.docx").write_bytes(b"PK\x03\x04junk")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Notice &amp; exit</w:t></w:r></w:p><w:p><w:r><w:t>Sixty</w:t><w:tab/><w:t>days.</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(folder / "exit.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    got = {r.filename: r for r in readers.ingest(spark, str(folder)).collect()}
    assert got["leave_policy.md"].text == "# Leave\n\nYou get twelve days of earned leave." and got["leave_policy.md"].title == "Leave policy"
    assert got["exit.docx"].text == "## Notice & exit\n\nSixty\tdays."
    assert {k: got[k].error for k in ("empty.txt", "x.exe", "bad.docx")} == {"empty.txt": "no text found", "x.exe": "unsupported type", "bad.docx": "content does not match its type"}
    assert got["broken.docx"].error.startswith("cannot be read")

    base = KnowledgeBase(spark, str(tmp_path / "kb"), embed=lambda texts: [[float(t.lower().count("leave")), float(t.lower().count("exit"))] for t in texts])
    assert base.ingest(str(folder)).where("error is null").count() == 2
    assert tuple(base.status().first())[1:] == (2, 2, 0)
    asked = spark.createDataFrame([(1, "how many days of earned leave"), (2, "zebra quantum")], "item_id int, text string")
    a = {r.question: r for r in base.ask(asked).collect()}
    assert a[1].mode in ("extractive", "none") and a[2].mode == "none" and a[1].confidence > a[2].confidence
    again = spark.createDataFrame([(1, "and days?", "how many days of earned leave"), (2, "zebra", None)], "item_id int, text string, previous string")
    b = {r.question: r for r in base.ask(again).collect()}
    assert b[1].mode == "extractive" and b[1].confidence > base.ask(again.drop("previous")).where("question = 1").first().confidence and b[2].mode == "none"
    base.remove(base.docs().where("filename = 'exit.docx'"))
    assert base.docs().count() == 1


def test_answers_written_declined_and_penalised(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "india.md").write_text("# Leave in India\n\nYou get twelve days of earned leave in India each year.")
    for i in range(10):
        (folder / f"zz{i}.txt").write_text(f"Parking, canteen menus and shuttle buses of building {i}.")
    (folder / "us.md").write_text("# Leave in America\n\nYou get twenty days of earned leave in America each year.")

    def generate(prompts):
        if any("broken" in p for p in prompts):
            raise RuntimeError("no model")
        return ["NO_ANSWER" if "notice" in p else "Six days [1]." if "Record:" in p else f"Passages: {p.count('[')} [2]" for p in prompts]

    base = KnowledgeBase(spark, str(tmp_path / "kb"), generate=generate)
    base.ingest(str(folder))
    schema = "item_id int, text string, record string, active string"
    ask = lambda *rows: {r.question: r for r in base.ask(spark.createDataFrame(rows, schema), owners).collect()}
    owners = base.docs().select("doc_id", F.col("filename").substr(1, 2).alias("owner"))
    got = ask((1, "how many days of earned leave", None, "us"), (2, "zebra", None, None), (3, "zebra", "Leave taken: 6", None), (4, "what is the average salary in my team", None, None), (5, "days of earned leave and notice", None, None))
    assert {q: (r.mode, r.answer) for q, r in got.items()} == {1: ("generated", "Passages: 2"), 2: ("none", None), 3: ("generated", "Six days."), 4: ("declined", None), 5: ("none", None)}
    assert (r := ask((6, "broken days of earned leave", None, "in"))[6]).mode == "extractive" and "India" in r.answer
    assert "America" in ask((7, "broken days of earned leave", None, "us"))[7].answer  # the other plan's document counts less


def test_snapshot_is_taken_once(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"docs": [')
    chunks = '{"id": "a#0", "docId": "a", "index": 0, "headings": ["Leave"], "text": "earned leave is twelve days", "tf": {"wrong": 9}}, {"id": "a#1", "docId": "a", "index": 1, "text": "sick leave is six days", "embedding": [1, 2]}, {"id": null, "text": "x"}, {"id": "a#2", "docId": "a", "index": 2, "text": null}'
    (tmp_path / "good.json").write_text('{"docs": [{"id": "a", "title": "Leave", "kind": "md"}, {"title": "no id"}], "chunks": [' + chunks + "]}")
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert tuple(base.import_snapshot(str(tmp_path / "bad.json")).first()) == (0, 0, 0) and base.chunks().isEmpty()
    assert tuple(base.import_snapshot(str(tmp_path / "good.json")).first()) == (1, 2, 1)
    assert tuple(base.import_snapshot(str(tmp_path / "good.json")).first()) == (0, 0, 0) and base.chunks().count() == 2
    asked = spark.createDataFrame([(1, "earned leave"), (2, "wrong")], "item_id int, text string")
    hits = base.search(asked)[0].where("rank = 1").join(base._passages().select("id", "body"), "id").collect()
    assert [(r.question, r.body) for r in hits] == [(1, "earned leave is twelve days")]


def test_sheets(spark, tmp_path):
    (tmp_path / "faq.csv").write_text('Question , Answer,Owner\n"How, then?","He said ""so"".\nTwice",HR\n,,\nWhy?,,X\n')
    sheet = readers.sheet(spark, str(tmp_path / "faq.csv"))
    assert sheet.count() == 2
    got = readers.question_sheet(sheet).collect()
    assert [r.body for r in got] == ['## How, then?\n\nHe said "so".\nTwice\n\n_owner: HR_']
    assert readers.delimiter('a;b;"x,y,z,w"\n') == ";" and readers.delimiter("a,b;c") == ","
    assert readers.records(sheet.limit(1)).first().body.startswith("- **Question")


def test_csv_files(spark, tmp_path):
    (tmp_path / "faq.csv").write_text('Question;Answer;Owner\n"How; then?";"He said ""so""."; HR\n;;\nWhy?;;X\n')
    (tmp_path / "list.csv").write_text("Name,Days\nEarned,12\nSick\n")
    (tmp_path / "one.csv").write_text("Name,Days\n")
    got = {r.filename: r for r in readers.ingest(spark, str(tmp_path)).collect()}
    assert got["faq.csv"].text == '## How; then?\n\nHe said "so".\n\n_Owner: HR_' and got["faq.csv"].note == "1 blank row skipped"
    assert got["list.csv"].text == "- Row 1 — **Name:** Earned · **Days:** 12\n- Row 2 — **Name:** Sick"
    assert got["one.csv"].text is None and got["one.csv"].error == "a sheet needs labels and a row"
    kinds = spark.createDataFrame([("a.MD", None), ("b", "text/csv"), ("c", "text/x"), ("d", "image/png")], "n string, m string")
    assert [r[0] for r in kinds.select(readers.kind_of(kinds.n, kinds.m)).collect()] == ["md", "csv", "txt", None]


def test_small_rules(spark, tmp_path):
    events = spark.range(2).select(store.access_event(F.lit("me"), F.lit(None).cast("string"), F.lit("denied"), F.lit("pay"), F.lit(None).cast("array<string>"), F.repeat(F.lit("q"), 301), F.lit(None).cast("string")).alias("e"))
    assert store.append(events, str(tmp_path / "log")) and store.append(events, str(tmp_path / "log")) and not store.append(events, "nowhere://log")
    kept = spark.read.parquet(str(tmp_path / "log")).select("e.*").collect()
    assert len(kept) == 4 and kept[0].fields == [] and kept[0].question == "q" * 300 + "…"
    reviews = spark.createDataFrame([(1, "FY 2022-23", "3", 1), (1, "FY 2023-24", " ", 2), (1, "FY 2022-23", "4", 3), (2, None, "5", 4)], "who int, cycle string, rating string, ord int")
    assert {(r.who, r.rating) for r in tables.latest_appraisal(reviews, "who").collect()} == {(1, "4"), (2, "5")}
    sizes = spark.createDataFrame([(1023,), (1024,), (1535,), (1536,), (1 << 20,)], "n long")
    assert [r[0] for r in sizes.select(values.byte_size(F.col("n"))).collect()] == ["1023 B", "1 KB", "1 KB", "2 KB", "1.0 MB"]


def test_hold_back(spark):
    pieces = [(1, 0, "x" * 50), (1, 1, "y" * 50), (1, 2, "z"), (2, 0, "short"), (3, 0, "NO_"), (3, 1, "ANSWER"), (4, 0, "I could not find"), (4, 1, " that, " + "z" * 100)]
    got = jobs.held_back(spark.createDataFrame(pieces, "answer_id int, seq int, piece string")).orderBy("answer_id", "seq").collect()
    assert [r.shown_chars for r in got] == [0, 100, 101, 5, 0, 0, 0, 0]
    assert [r.released for r in got] == ["", "x" * 50 + "y" * 50, "z", "short", "", "", "", ""]
