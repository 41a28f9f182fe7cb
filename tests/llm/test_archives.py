"""WARC archives: round trips, pushed filters, revisits against SQL, damaged files."""

import io

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillstream.llm import warc

LONG = "<p>" + "WARC/1.1\r\n\r\n" * 40_000


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("warc")
    html = [f"<p>{'wörd ' * (20 + i)}</p>" for i in range(20)]
    rows = [(i, f"http://x/{i}", html[i % 20] if i % 7 else ("tiny" if i % 2 else None)) for i in range(400)]
    rows += [(None, None, html[1]), (1, "again", html[1]), (901, "big\r\none", LONG), (902, "", ""), (None, "u", "only this one " * 10), (None, "v", "only this one " * 10)]
    names = ["page_id", "url", "html", "payload_digest", "first"]
    pq.write_table(pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array(["x"] * len(rows)), pa.array([0] * len(rows))], names), folder / "pages.parquet")
    return folder


def _key(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_op11_equals_sql(spark, pages):
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{pages}/pages.parquet'")
    got = warc.op11_warc_records(spark, str(pages))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = got.collect()
    assert _key(rows) == _key(duck.execute(warc.SQL).fetchall())
    assert sum(r.record_type == "revisit" for r in rows) > 300


@pytest.mark.parametrize("level", ["0", "3"])
def test_archive_round_trip_and_filters(spark, pages, level):
    source = spark.read.parquet(f"{pages}/pages.parquet")
    path = f"{pages}/archive{level}"
    warc.write(warc.told(source).repartition(3), path, level=level, fileBytes="20000")
    records = warc.read(spark, path, partitionBytes="1")
    assert records.count() == source.count() and records.rdd.getNumPartitions() > 3
    wanted = {(r.page_id, r.html) for r in source.collect() if r.page_id is not None}
    kept = records.where("record_type = 'response' and page_id is not null")
    assert {(r.page_id, bytes(r.payload).decode()) for r in kept.collect()} <= {(i, h or "") for i, h in wanted}
    plan = records.where("record_type = 'revisit' and page_id > 100 and payload_bytes > 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull(payload_bytes" in plan and "revisit" not in plan  # the rest is the source's
    for where in ("record_type = 'revisit' and page_id > 100", "page_id in (1, 2, 901)", "target_uri like 'http://x/1%'", "refers_to is null", "not page_id <= 390", "page_id <=> null", "payload_digest is not null and target_uri like '%9'"):
        assert records.where(where).count() == records.cache().where(where).count(), where
    records.unpersist()
    assert records.where("page_id = 901").first().target_uri == "big%0D%0Aone"


def test_unwanted_blocks_are_not_decoded():
    record = warc.encoded(1, "response", "u", None, "d", 50_000, b"x" * 50_000)
    for data in (record * 3, warc.member(record, 3) * 3):
        archive = warc.Archive(io.BytesIO(data), "f")
        assert sum(1 for _ in archive.records(lambda fields: False)) == 0 and archive.at == len(data) and archive.decoded == 0
        assert [len(block(None)) for _, block in archive.records(lambda fields: False)] == []
        archive = warc.Archive(io.BytesIO(data), "f")
        assert [block(None)[-3:] for _, block in archive.records(lambda fields: True)] == [b"xxx"] * 3


def test_foreign_members_and_plain_records():
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nX-Folded: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    archive = warc.Archive(io.BytesIO(gzip.compress(record) + gzip.compress(record)), "f")
    assert [(f["warc-type"], f["x-folded"], block(None)) for f, block in archive.records(lambda fields: True)] == [("resource", "a b", b"hello")] * 2
    with pytest.raises(ValueError, match="f at byte 0"):
        list(warc.Archive(io.BytesIO(b"not an archive, but long enough to be read\r\n\r\n"), "f").records(lambda fields: True))
    cut = warc.Archive(io.BytesIO(gzip.compress(record)[:40]), "f")
    with pytest.raises(ValueError, match="ends early"):
        [block(None) for _, block in cut.records(lambda fields: True)]


def test_lost_tasks_leave_no_records(spark, pages):
    """Files that the list does not name, as a doubled task leaves them, are not read."""
    path = f"{pages}/listed"
    warc.write(warc.told(spark.read.parquet(f"{pages}/pages.parquet")), path)
    (pages / "listed" / "part-000000-stray.warc").write_bytes(warc.encoded(5, "response", "u", None, "d", 1, b"x"))
    assert warc.read(spark, path).where("payload_digest = 'd'").count() == 0


def test_op11_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op11_warc_records(spark, str(tmp_path)).collect() == []
