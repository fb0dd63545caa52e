"""Vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators.vectors import VectorIndex, recall

SCHEMA = "id long, vector array<float>"


def brute(rows, queries, k):
    def unit(v):
        v = np.array(v, np.float32).astype(np.float64)
        return v / np.linalg.norm(v)

    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    rows = [(i, unit(v)) for i, v in rows if usable(v) and i is not None]
    out = set()
    for q, v in queries:
        if usable(v) and q is not None:
            scored = sorted((-round(float(unit(v) @ x), 9) + 0.0, i) for i, x in rows if i != q)[:k]
            out |= {(q, n + 1, i, -s + 0.0) for n, (s, i) in enumerate(scored)}
    return out


def clouds(n, width=16, centres=20, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    points = middle[rng.integers(centres, size=n)] + 0.4 * rng.normal(size=(n, width))
    return [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]


def found(df):
    return {tuple(r) for r in df.collect()}


def test_exact_search(spark, folder):
    rows = clouds(700)
    df = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex.build(df, folder)
    got = found(index.search(df.where("id % 50 = 0"), 7, probes=None))
    assert {r[:3] for r in got} == {r[:3] for r in brute(rows, rows[::50], 7)}
    assert sum(len(r.ids) for r in index.blocks().collect()) == 700


@pytest.mark.parametrize("seed", [3, 4])
def test_recall_of_probed_cells(spark, folder, seed):
    df = spark.createDataFrame(clouds(4000, seed=seed), SCHEMA)
    index, queries = VectorIndex.build(df, folder), df.where("id % 50 = 0")
    exact = index.search(queries, 10, probes=None)
    assert recall(index.search(queries, 10), exact) >= 0.95
    assert recall(index.search(queries, 10, probes=1), exact) < 1


def test_unusable_vectors_and_repeated_ids(spark, folder):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [-1.0, 0.0]), (None, [1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cell": F.lit("x"), "score": F.lit(1), "rank": F.lit(2)})
    index = VectorIndex.build(df, folder, cells=2)
    assert found(index.search(df, 3, probes=None)) == brute(rows, rows, 3)
    assert found(index.search(df, 3, probes=2)) == brute(rows, rows, 3)
    again = spark.createDataFrame([(1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 0.1])], SCHEMA)
    twice = VectorIndex.build(again, folder + "2", cells=1)
    assert [r.id for r in twice.search(again.where("id = 2"), 5).orderBy("rank").collect()] == [1, 1]
    other_width = spark.createDataFrame([(50, [1.0, 0.0, 0.0])], SCHEMA)
    assert found(twice.search(other_width, 5)) == set()


def test_ties_go_to_the_smallest_ids_across_blocks(spark, folder):
    df = spark.range(5000).select("id", F.expr("array(1.0F, 2.0F, cast(id >= 4990 AS float))").alias("vector"))
    index = VectorIndex.build(df, folder, cells=3)
    got = index.search(df.where("id IN (0, 4000)"), 4)
    assert {(r.query_id, r.rank, r.id) for r in got.collect()} == {(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (4000, 1, 0), (4000, 2, 1), (4000, 3, 2), (4000, 4, 3)}


def test_empty_index_and_mixed_widths(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    index = VectorIndex.build(empty, folder)
    assert index.search(spark.createDataFrame([(1, [1.0])], SCHEMA), 3).collect() == []
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), folder)


def test_plan_prunes_cells_and_limits_ranks_before_the_shuffle(spark, folder):
    df = spark.createDataFrame(clouds(1000), SCHEMA)
    index = VectorIndex.build(df, folder)
    plan = index.search(df.where("id = 0"), 5, probes=2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "PartitionFilters: [cell" in plan


def test_recall_on_the_given_embeddings(spark):
    from workload.vectors import search

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        assert recall(search(spark, sf), search(spark, sf, probes=None)) >= 0.95
