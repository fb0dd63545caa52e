"""Line dedup against dictionaries of lines."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
MENU = "Home | Products | About"
ROWS = [
    (1, f"{MENU}\nunique first line\n{MENU}\n"), (2, f"  {MENU.upper()}\t\nunique second line"), (3, MENU), (4, None), (5, ""), (6, "\n\n"),
    (7, "short\nshort line"), (8, "short\nshort line"), (9, "ÉCOLE DE PARIS"), (10, "école de paris"), (11, "ÉCOLE de paris  "), (12, "\x0b\x0cpadded line here\r"),
    (13, "padded line here"), (14, "padded line here "), (15, "\xa0padded line here"), (16, "twice in one doc\ntwice in one doc"),
    (17, "repeated row text"), (17, "repeated row text"), (18, "same id, other text\ntwo of one id"), (18, "two of one id"), (19, "two of one id\nlast line of it"),
    (None, f"{MENU}\nline without an id"), (None, "line without an id"), (20, "line without an id"), (None, None), (21, "123456789\n1234567890"), (22, "123456789\n1234567890"),
    (23, "éééééééééé"), (24, "ééééééééééé\néééééééééé"), (25, "\n".join(f"numbered line {i % 3000}" for i in range(6000))), (26, "\n".join(f"numbered line {i}" for i in range(2900))),
    (-3, "the negative id has it\nx"), (27, "y\nthe negative id has it"), (28, "w " * 100000), (29, " " * 50000 + "\n" + "w " * 100000),
]


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def expected(rows, least_chars=10, least_documents=2):
    order = lambda i: (i is None, i or 0)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < least_documents or min(held[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({"_doc": F.lit("x"), "_lines": F.lit(1), "_LOST": F.lit(2), "at": F.lit("p"), "key": F.lit("k"), "first": F.lit(3)})


@pytest.mark.parametrize(("chars", "documents"), [(10, 2), (1, 2), (10, 3), (0, 4), (10, 1)])
def test_edge_rows(spark, chars, documents):
    docs = frame(spark, ROWS)
    made = line_dedup.drop_shared_lines(docs, least_chars=chars, least_documents=documents)
    assert made.columns == [*docs.columns, "n_lines", "n_dropped", "kept"]
    got = made.select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS, chars, documents)
    assert {tuple(r)[2:8] for r in made.collect()} == {("x", 1, 2, "p", "k", 3)}


def test_empty_table(spark):
    assert line_dedup.drop_shared_lines(frame(spark, [])).collect() == []


def test_a_line_of_all_documents_and_copies(spark):
    rows = [(i, f"{MENU}\nown line number {i}\n{MENU}") for i in range(500)] + [(1000 + i, "copied text\nsecond line of it") for i in range(500)]
    got = line_dedup.drop_shared_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_a_line_of_all_documents_is_joined_by_many_tasks(spark):
    docs = spark.range(40000, numPartitions=4).selectExpr(
        "id AS doc_id", f"concat('{MENU}', '\\n', 'own line number ', id, '\\n', '{MENU} ') AS text"
    )
    made = line_dedup.drop_shared_lines(docs)
    assert tuple(made.agg(F.sum("n_dropped"), F.sum("n_lines")).first()) == (2 * 39999, 120000)


def test_dropping_is_idempotent(spark):
    once = line_dedup.drop_shared_lines(frame(spark, ROWS)).select("doc_id", F.col("kept").alias("text"))
    twice = line_dedup.drop_shared_lines(once)
    assert twice.where("n_dropped > 0").count() == 0
