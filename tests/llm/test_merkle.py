"""The manifest against a tree built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, fields=SCHEMA):
    parts = []
    for value in row:
        value = None if value is None else str(value)
        parts.append("-" if value is None else f"{len(value.encode())}:{value}")
    return h(*parts)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([h(*n[i : i + 8]) for i in range(0, len(n), 8)])
    return levels


def steps(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at - at % 8
        out.append((nodes[run:at], nodes[at + 1 : run + 8]))
        at //= 8
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, ordered = {}, {}
    for g in names:
        ordered[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in ordered[g]])
    top = tree([trees[g][-1][0] for g in names])
    root, out = top[-1][0] if names else None, []
    for i, g in enumerate(names):
        for at, row in enumerate(ordered[g]):
            path = steps(trees[g], at) + steps(top, i)
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = lowered(text)
            node = leaf((*row[:4], text))
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*[x for before, after in path for x in before + after])
            out.append((row[0], leaf(row), trees[g][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "at": F.lit(1), "digest": F.lit("y"), "Leaf": F.lit(2)})
    return sorted(map(tuple, merkle.verify(docs).collect()), key=str)


EDGES = [
    (1, "s", "en", 3, "Abc"), (2, None, "en", None, None), (3, "s", None, 0, ""), (None, "s", "en", 1, "A"), (None, None, None, None, None),
    (4, "s", "é", 5, "ÉCOLE Abc"), (5, "s", "z", 1, "Z"), (5, "s", "z", 1, "Z"), (5, "t", "z", 1, "a"), (6, "s", "", 1, "Q"), (-7, "s", "en", 9, "NEG"),
    (8, "s", "Z", 100000, "Long Text " * 20000), (12, "1:s", "en", 1, "x-"), (15, "s", "\U0001F600", 1, "\U0001F600"), (16, "s", "￿", 1, "B"),
]


def test_edge_rows(spark):
    assert got(spark, EDGES) == expected(EDGES)


def test_sizes_of_a_tree(spark):
    # Around the sizes at which a run, a subtree or a persisted level is full.
    sizes = [1, 2, 8, 9, 64, 65, 511, 512, 513, 520, 4097]
    rows = [(i * 8191 % 100003, "s", f"g{n}", 1, f"Text {i}") for n in sizes for i in range(n)]
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("n", [1, 600])
def test_one_group(spark, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
    assert got(spark, rows) == expected(rows)


def test_more_than_one_stored_level_and_many_groups(spark):
    rows = [(i, "s", f"g{i % 700}" if i > 2000 else "big", i, f"T{i}") for i in range(4000)]
    assert got(spark, rows) == expected(rows)


def test_a_repeated_row_many_times(spark):
    rows = [(3, "s", "en", 1, "Same")] * 600 + [(4, "s", "en", 1, "Other")]
    assert got(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_paths_verify_and_persisted_levels_are_few(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "id as n_chars", "concat('T', id) as text")
    made = merkle.manifest(docs)
    # 5,000 leaves have five levels of nodes above them; only the first and the fourth level are stored.
    assert [level.count() for level in made.groups.levels] == [10, 1]
    found = merkle.proofs(made)
    assert found.where(merkle.climb(F.col("digest"), F.col("path")) != F.col("root")).count() == 0
    assert found.where(F.size("path") != 5).count() == 0
    wrong = found.where(merkle.climb(F.sha2("digest", 256), F.col("path")) == F.col("root"))
    assert wrong.count() == 0
