"""Queries that read messages whole."""

from quillstream.plans import catalogue


def test_keyword_flags_read_whole_messages(spark, tmp_path):
    """What stands behind the sixth word of a turn counts too."""
    turns = [(0, 5, "user", "one two three four five six seven the 8 and my salary ?"), (0, 15, "user", "one two three four five six seven")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.has_article, r.has_digit, r.asks) for r in catalogue.QUERIES["cls_keyword_flags"](spark, str(tmp_path)).collect()}
    assert got == {5: (True, True, True), 15: (False, False, False)}
