"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

from quillstream.llm import manifest


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(row):
    return _h("".join(map(_field, row)))


def _tree(nodes):
    """The root, and for each leaf its (left, right) siblings from the bottom up."""
    found, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, covers = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for j in range(len(run)):
                for i in under[a + j]:
                    found[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(_h("".join(run)))
            covers.append([i for group in under[a : a + 3] for i in group])
        nodes, under = up, covers
    return nodes[0], found


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for s in sources]
    trees = [_tree([_leaf(r) for r in g]) for g in groups]
    root, above = _tree([t[0] for t in trees])
    out = []
    for group, (subroot, below), up in zip(groups, trees, above):
        for row, path in zip(group, below):
            steps, now = path + up, row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                now = (*row[:4], row[4].replace("\n", ""))
            node = _leaf(now)
            for left, right in steps:
                node = _h(left + node + right)
            out.append((row[0], _leaf(row), subroot, root, _h("".join(a + b for a, b in steps)), node, node == root))
    return out


def _check(spark, folder, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path string, up int")
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    got = manifest.op13_merkle_manifest(spark, str(folder))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute(rows)))


def test_op13_equals_plain_trees(spark, tmp_path):
    """Groups of 1 to 120 rows, hot and null ones, null and repeated keys, equal rows, odd texts."""
    rows = [(i, f"s{i % 4}" if i % 3 else "hot", "en", i, f"text {i}\nline\n") for i in range(360)]
    rows += [(1000 + i, None, None, None, None) for i in range(5)] + [(None, "hot", "de", 1, f"no id {i % 2}\n") for i in range(4)]
    rows += [(7, "hot", "en", 3, "again"), (7, "hot", "en", 3, "again"), (8, "", "fr", 0, ""), (9, "ünï", "fr", 2, "é\n" * 50_000), (10, "Z", "fr", 2, "lone")]
    _check(spark, tmp_path, rows)


def test_op13_small_shapes(spark, tmp_path):
    """One row; one group; only groups of one row."""
    _check(spark, tmp_path / "a", [(4, "s", "en", 1, "a\nb")])
    _check(spark, tmp_path / "b", [(i, "s", "en", 1, "a\nb") for i in range(28)])
    _check(spark, tmp_path / "c", [(i, f"s{i}", "en", 1, "a\nb") for i in range(10)])


def test_op13_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest.op13_merkle_manifest(spark, str(tmp_path)).collect() == []
