"""Greedy documents and multiple choice against direct walks."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import materialisers
from chunkloom.plans.cuts import greedy_cuts, next_cuts, reached
from chunkloom.plans.ranking import totals_in_group

CHUNKS = "source_id long, chunk_id string, token_count int, text string"


def walk(rows, limit):
    """(group, id) -> document, taking sized rows while they fit."""
    out, groups = {}, {}
    for g, i, size in rows:
        groups.setdefault(g, []).append((i, size))
    for g, members in groups.items():
        doc, total, begun = 0, 0, False
        for i, size in sorted(members):
            size = max(size or 0, 0)
            if size and begun and total + size > limit:
                doc, total = doc + 1, 0
            begun |= size > 0
            total += size
            out[g, i] = doc
    return out


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_cuts_of_random_sizes(spark, limit):
    rng = random.Random(limit)
    rows = [("hot", i, rng.choice([0, 1, 2, 3, 5, 8, 13, 60, None, -2])) for i in range(900)]
    rows += [(f"g{i % 40}", i, rng.randrange(30)) for i in range(400)] + [("zeros", i, 0) for i in range(5)] + [("giant", 0, 500), ("giant", 1, 1), ("giant", 2, 0)]
    df = spark.createDataFrame(rows, "g string, id int, size int").repartition(5)
    got = greedy_cuts(df, ["g"], ["id"], "size", limit)
    assert got.columns == ["g", "id", "size", "pos", "cut"]
    assert {(r.g, r.id): r.cut for r in got.collect()} == walk(rows, limit)


def test_totals_run_over_ranges(spark):
    rows = [("a", i, i % 7) for i in range(500)] + [("b", 3, 4)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = totals_in_group(df, ["g"], ["o"], {"before": "v"}, parts=6).collect()
    want = {("b", 3): 0} | {("a", i): sum(j % 7 for j in range(i)) for i in range(500)}
    assert {(r.g, r.o): r.before for r in got} == want


def test_pointers_and_reach(spark):
    rows = spark.createDataFrame([(1, i, 10 * i, 10) for i in range(100)], "group long, pos long, before long, size long")
    cuts = next_cuts(rows, 35)
    assert {(r.pos, r.next) for r in cuts.collect()} == {(i, i + 3 if i + 3 < 100 else None) for i in range(100)}
    assert sorted(r.pos for r in reached(cuts).collect()) == list(range(0, 100, 3))


def test_a_window_holds_one_slot_only(spark):
    rows = spark.range(20000).selectExpr("1L AS group", "id AS pos", "id * 10 AS before", "10L AS size")
    plan = next_cuts(rows, 100)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(group" in plan and ", slot" in plan


def test_concat(spark):
    rows = [(1, "1_0", 3, "a"), (1, "1_1", 3, "b"), (1, "1_2", 4, "c"), (1, "1_10", 1, "e"), (1, "1_9", 9, "d"), (None, "x_0", 2, None), (None, "x_1", None, "n"), (2, "2_0", 99, "big")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    got = {tuple(r) for r in materialisers.cpt_concat(chunks, 10, separator="+").collect()}
    assert got == {(1, 0, 3, 10, "a+b+c"), (1, 1, 2, 10, "d+e"), (None, 0, 2, 2, "+n"), (2, 0, 1, 99, "big")}
    assert materialisers.cpt_concat(chunks.limit(0), 10).collect() == []
    with pytest.raises(ValueError):
        materialisers.cpt_concat(chunks, 0)


def test_one_source_with_most_chunks(spark):
    chunks = spark.range(6000).selectExpr(
        "if(id < 4000, 0, id) AS source_id", "concat(if(id < 4000, 0, id), '_', if(id < 4000, id, 0)) AS chunk_id", "int(1 + id % 9) AS token_count", "concat('t', id) AS text"
    )
    got = materialisers.cpt_concat(chunks, 64, separator=" ").where("source_id = 0").orderBy("doc").collect()
    docs = walk([(0, i, 1 + i % 9) for i in range(4000)], 64)
    want = [" ".join(f"t{i}" for i in range(4000) if docs[0, i] == d) for d in range(max(docs.values()) + 1)]
    assert [r.text for r in got] == want


def test_chat_rows(spark):
    chunks = spark.createDataFrame([(1, "1_0", 3, 'say "a"\n'), (1, "1_1", 3, None)], CHUNKS)
    got = {r.chunk_id: json.loads(r.messages) for r in materialisers.sft_from_chunks(chunks, "{{x}} {token_count}: {chunk_text}").collect()}
    assert got["1_0"] == [{"role": "user", "content": '{x} 3: say "a"\n'}, {"role": "assistant", "content": 'say "a"\n'}]
    assert got["1_1"][1]["content"] == ""
    with pytest.raises(ValueError):
        materialisers.sft_from_chunks(chunks, "{nothing}")


def ring(rows, k, seed=42):
    def md5(text):
        return hashlib.md5(f"{seed}:{text}".encode()).hexdigest()

    out = {}
    for i, q, a, g in rows:
        if a is not None:
            circle = sorted({x for _, _, x, h in rows if h == g and x is not None}, key=lambda x: (md5(x), x))
            at = circle.index(a)
            others = [circle[(at + n) % len(circle)] for n in range(1, k + 1)]
            options = sorted({a, *others}, key=lambda o: md5(f"{i}:{o}"))
            out[i] = (q, options, options.index(a))
    return out


@pytest.mark.parametrize(("k", "parts"), [(1, 1), (3, 2), (3, 7), (5, 3)])
def test_multiple_choice(spark, k, parts):
    rows = [(i, f"q{i}", f"answer {i % 90}", "big") for i in range(300)] + [(400 + i, "q", f"a{i}", "small") for i in range(k)]
    rows += [(500, "q", "alone", "one"), (501, "q", None, "one"), (502, "q", "x", None), (503, "q", "y", None), (504, None, "x", None)]
    rows += [(600 + i, "q", "same", "big") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, question string, answer string, group string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts + 1))
    try:
        got = materialisers.multiple_choice(df, k).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r.id: (r.question, r.options, r.answer_at) for r in got} == ring(rows, k)
    assert len(got) == len({r.id for r in got})


def test_multiple_choice_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, question string, answer string, group string")
    assert materialisers.multiple_choice(empty).collect() == []
    with pytest.raises(ValueError):
        materialisers.multiple_choice(empty, 0)


def test_plain(spark):
    chunks = spark.createDataFrame([(1, "1_0", 3, "a"), (1, "1_1", 3, None)], CHUNKS).withColumn("other", F.lit(1))
    assert {tuple(r) for r in materialisers.cpt_plain(chunks, "body").collect()} == {("1_0", "a"), ("1_1", None)}
