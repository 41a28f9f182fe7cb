"""Repeats of lines of one or two distinct words."""

from test_small import frame

from quillstream.llm import line_dedup


def lines_by_force(rows):
    seen, out = [], {}
    for i, t, *_ in rows:
        for n, line in enumerate(t.lower().split("\n")):
            if s := frozenset(line.split()):
                hit = next(((a, b) for a, b, o in seen if 5 * len(s & o) >= 4 * len(s | o)), None)
                if hit:
                    out[(i, n)] = hit
                seen.append((i, n, s))
    return out


def test_op2_short_lines(spark):
    """All lines that are not blank take part; no least number of words is left out of the brute force either."""
    rows = [(i, f"Read more\nof.\n\nown line number {i} of this\n{'again ' * 100}\nmore READ\nword{i}\n \t", "en", "s") for i in range(30)]
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in line_dedup.repeated_lines(frame(spark, rows)).collect()}
    assert got == lines_by_force(rows) and sum(kept == (0, 0) for kept in got.values()) == 59
