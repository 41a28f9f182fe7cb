"""Stateful streams: any division into batches, stops and restarts give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from quillstream.streaming import jobs, stateful, upserts


def _parts(rows, folder, batches):
    """The rows as a stream that takes a file for each batch; ``batches`` is a function of a row's place."""
    for b in sorted({batches(i) for i in range(len(rows))}):
        rows_of = [r for i, r in enumerate(rows) if batches(i) == b]
        yield rows_of, f"{folder}/in/{b:03d}"


def _stream(spark, rows, schema, folder, batches):
    for part, path in _parts(rows, folder, batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


TALK = "conv_id long, turn long, role string, text string, decision string, intent string, confidence double, route string, soft boolean, record boolean, covered boolean, options string"


def _said(conv, turn, text, decision="answer", intent="leave", route="none", soft=False, record=False, covered=True, options=None):
    return (conv, turn, "user", text, decision, intent, 0.5, route, soft, record, covered, options)


TURNS = [
    _said(1, 0, "hello there"), _said(1, 1, "how many days of leave", covered=False), _said(1, 2, "yes please"), _said(1, 3, "ok"),
    _said(2, 0, "what does posh cover", intent="posh", soft=True), _said(2, 1, "yes"), _said(2, 2, "thanks a lot"),
    _said(3, 0, "he assaulted me", "sensitive", "misconduct", "hr_head"), _said(3, 1, "please raise a ticket"), _said(3, 2, "how do i raise a ticket"),
    _said(4, 0, "leave?", "clarify", options="Leave policy|Sick leave balance"), _said(4, 1, "the second one"), _said(4, 2, "insurance", "clarify", options="Health cover|Motor cover"), _said(4, 3, "neither"),
    _said(5, 0, "leave rules"), _said(5, 1, "what about sick", "escalate", None), _said(5, 2, "zzz", "escalate", None, covered=False), _said(5, 3, "no thanks"), _said(5, 4, "my leave balance", intent="balance", record=True),
    (6, 0, "assistant", "welcome", None, None, None, None, None, None, None, None), _said(6, 1, None, covered=False), _said(6, 2, ""), _said(6, 1, None, covered=False),
]
WANT = {
    (1, 0): "greeting", (1, 1): "not_covered", (1, 2): "ticket_accepted", (1, 3): "acknowledged",
    (2, 0): "answer", (2, 1): "ticket_accepted", (2, 2): "thanks",
    (3, 0): "ticket_sensitive", (3, 1): "ticket_requested", (3, 2): "answer",
    (4, 0): "clarify", (4, 1): "chosen", (4, 2): "clarify", (4, 3): "ticket_none_fits",
    (5, 0): "answer", (5, 1): "answer", (5, 2): "not_covered", (5, 3): "offer_declined", (5, 4): "record",
    (6, 1): "not_covered", (6, 2): "answer",
}


@pytest.mark.parametrize("batches", [lambda i: 0, lambda i: i % 2, lambda i: -i % 5], ids=["one", "two", "backwards"])
def test_dialogue_states(spark, tmp_path, batches):
    got = jobs.drain(stateful.dialogue(_stream(spark, TURNS, TALK, tmp_path, batches)), "append", timed=True).collect()
    assert {(r.conv_id, r.turn): r.action for r in got} == WANT and len(got) == len(WANT)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[2, 1].route == "hr_head" and by[2, 1].confidential and by[2, 1].about_turn == 0  # consent to the confidential offer
    assert by[1, 2].route == "hr_ops" and not by[1, 2].confidential and by[1, 2].about_turn == 1
    assert by[3, 1].route == "hr_head" and by[3, 1].confidential  # a ticket asked for after a report is not downgraded
    assert by[4, 1].intent == "Sick leave balance" and by[5, 1].intent == "leave"
    assert [by[1, t].offered for t in range(4)] == [False, True, False, False]


def test_choices():
    options = ["Leave policy & entitlement", "My leave balance", "Health insurance"]
    assert stateful.chosen("2", options) == options[1] and stateful.chosen("the third", options) == options[2] and stateful.chosen("option 9 insurance", options) == options[2]
    assert stateful.chosen("tell me about leave policy?", options) == options[0] and stateful.chosen("gratuity", options) is None


PIECES = [(1, 0, "x" * 50), (1, 1, "y" * 50), (1, 2, "z"), (2, 0, "short"), (3, 0, "NO_"), (3, 1, "ANSWER"), (4, 0, "I could not find"), (4, 1, " that, " + "z" * 100), (5, 0, "a" * 95), (5, 1, "b"), (5, 2, None), (5, 3, "late")]
PIECE = "answer_id long, seq long, piece string, last boolean, cancel boolean"


def _pieces():
    ends = {k: max(s for a, s, _ in PIECES if a == k) for k, *_ in PIECES}
    return [(a, s, p, s == ends[a] and a != 5, a == 5 and s == 2) for a, s, p in PIECES]


def test_hold_back_survives_a_stop(spark, tmp_path):
    """A query stopped after its first batches and started again releases what one run releases, once."""
    rows = _pieces()
    stream = stateful.held_back_stream(_stream(spark, rows, PIECE, tmp_path, lambda i: i * 7 % 4))
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    start = lambda **trigger: stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(**trigger).start()
    run = start(processingTime="0 seconds")
    for _ in range(600):
        if (run.lastProgress or {}).get("batchId", -1) >= 1:
            break
        run.awaitTermination(0.1)
    run.stop()
    with jobs.data_batches_only(spark):
        run = start(availableNow=True)
    run.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    pieces = {(r.answer_id, r.seq): r.released for r in got if r.kind == "piece"}
    replay = jobs.held_back(spark.createDataFrame([r[:3] for r in rows if r[0] < 5], "answer_id long, seq long, piece string")).collect()
    assert {k: v for k, v in pieces.items() if k[0] < 5} == {(r.answer_id, r.seq): r.released for r in replay}
    assert sorted((r.answer_id, r.kind, r.shown_chars) for r in got if r.kind != "piece") == [(1, "final", 101), (2, "final", 5), (3, "refused", 0), (4, "refused", 0), (5, "cancelled", 96)]
    assert len(got) == len(pieces) + 5 and (5, 3) not in pieces


def test_denials_in_any_division(spark, tmp_path):
    rows = [(u, e, ((u or 3) * 7 + e * 13) % 50 * 300_000_000 + 10**15) for u in (1, 2, None) for e in range(40)]
    times = lambda df: df.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"))
    stream = times(_stream(spark, rows, "user_id long, event_id long, at long", tmp_path, lambda i: i % 3))
    got = jobs.drain(stateful.denial_alerts(stream, late="3 days"), "update").groupBy("user_id", "event_id").agg(F.max("recent")).collect()
    count = lambda u, at: sum(v == u and at - 3_600_000_000 < b <= at for v, _, b in rows)
    want = {(u, e): count(u, at) for u, e, at in rows if u is not None and count(u, at) >= 3}
    assert want and {(a, b): n for a, b, n in got} == want


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    table = upserts.sightings(spark, str(tmp_path / "t"))
    table.buckets = 8
    batch = lambda ids, at: spark.createDataFrame([(i, at) for i in ids], "user_id long, at long").select("user_id", F.timestamp_seconds("at").alias("ts"))
    assert table.read().count() == 0
    table.apply(batch([*range(100), None, 5], 10), 0)
    first = dict(table._commits().orderBy(F.desc("batch")).first().files)
    table.apply(batch([5, 5], 5), 1)
    second = dict(table._commits().orderBy(F.desc("batch")).first().files)
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    table.apply(batch([5, 7], 5), 1)  # the batch again: nothing happens
    row = table.read().where("user_id = 5").first()
    assert (row.n, row.first_at.timestamp(), row.last_at.timestamp()) == (4, 5.0, 10.0) and table.read().count() == 100
    table.apply(batch([5, 1000], 20), 2)
    assert table.read().where("user_id = 5").first().n == 5 and table.read().count() == 101
    kept = {p.parent.name + "/" + p.name for p in (tmp_path / "t" / "data").glob("*/bucket=*")}
    assert not {n for n in first.values() if n not in second.values()} & kept  # replaced two versions ago
