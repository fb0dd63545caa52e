"""Decontamination against a direct search for every window."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
P = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda"
DOCS = [
    (1, P), (2, f"x {P} y {P.upper()}"), (3, None), (4, ""), (5, "... !!"), (6, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (7, f"beta {P[6:]} alpha"), (8, "the the the the"), (8, "the the the the"), (8, "the"), (None, f"{P} mu"), (9, "ÉTÉ été"), (10, "École été"),
    (11, "Kelvin"), (12, "kelvin K"), (13, f"{'w ' * 3000}{P}{' w' * 3000}"), (14, "w " * 12),
]
ITEMS = [(1, P), (2, f"{P} mu nu"), (2, "the"), (3, None), (4, " . "), (5, "été"), (None, "kelvin"), (10, "w w w w w w w w w w w"), (11, "École ÉTÉ")]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    windows = {(i, tuple(w[a : a + 10])) for i, t in items for w in [words(t)] if w for a in range(max(1, len(w) - 9))}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, window in windows:
            for a in range(len(w) - len(window) + 1):
                if tuple(w[a : a + len(window)]) == window:
                    hit |= set(range(a, a + len(window)))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("pos", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("key", F.lit("x"))
    return docs, items


@pytest.mark.parametrize("block", [3, decontam.BLOCK_WINDOWS])
def test_edge_rows(spark, block):
    docs, items = frames(spark)
    got = sorted(map(tuple, decontam.report(docs, items, block_windows=block).collect()), key=str)
    assert got == expected(DOCS, ITEMS)


def test_clean_keeps_rows_and_columns(spark):
    docs, items = frames(spark)
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    want = [(i, t) for i, t in DOCS if not expected([(i, t)], ITEMS)[0][5]]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontam.report(docs.limit(0), items).count() == 0
    assert decontam.report(docs, items.limit(0)).where("contaminated OR n_items > 0").count() == 0
    assert decontam.report(docs, items.limit(0)).count() == len(DOCS)


def test_no_python_and_one_split_on_the_main_path(spark):
    docs, items = frames(spark)
    parts = decontam.keyed_windows(decontam.item_windows(items, "item_id", "text"))
    anchors = decontam.anchors_of(parts, decontam.window_sets(parts), spark.createDataFrame([("alpha", 3)], "word string, uses long"))
    hits = decontam.window_hits(docs, anchors, "doc_id", "text")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    # The documents' text is split once, the items' in the broadcast.
    assert plan.split("BroadcastExchange")[0].count("regexp_extract_all") == 1
    for plan in (plan, decontam.report(docs, items)._jdf.queryExecution().executedPlan().toString()):
        assert not re.search("Python|Arrow|Pandas", plan)


def test_items_that_share_a_passage_are_listed_once_for_all_documents(spark):
    passage = " ".join(f"shared{i}" for i in range(40))
    items = spark.range(3000).selectExpr("id AS item_id", f"concat('{passage} own', id) AS text")
    docs = spark.range(200).selectExpr("id AS doc_id", f"concat('x', id, ' {passage} ', if(id = 7, 'own9', 'y')) AS text")
    hits, members = decontam.all_hits(docs, items)
    # 31 windows of the passage have one set, the last window of each item another; items are written once for each set.
    assert hits.where("set IS NOT NULL").select("set").distinct().count() == 2
    assert members.count() == 6000
    got = {r.doc_id: r for r in decontam.report(docs, items).collect()}
    every = hashlib.sha256(",".join(sorted(str(i) for i in range(3000))).encode()).hexdigest()
    assert all((r.n_hit, r.n_items, r.items_sha256) == (41 if i == 7 else 40, 3000, every) for i, r in got.items()) and len(got) == 200


def test_clashing_names(spark):
    docs, items = frames(spark)
    docs = docs.withColumns({"_hit_id": F.lit(1), "_HIT_BODY": F.lit("x"), "set": F.lit(2), "body": F.lit("b")})
    plain = decontam.clean(docs.select("doc_id", "text"), items)
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, plain.collect()))
