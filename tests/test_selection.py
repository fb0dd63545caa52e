"""Selections of chunks on small literals."""

import pytest
from pyspark.sql import functions as F

from chunkloom.plans import explore, selection
from chunkloom.plans.filters import QueryError
from chunkloom.session import discard, materialize

CHUNK = "chunk_id string, source_id bigint, source_collection_id bigint, augmented_from string, text string"


@pytest.fixture
def chunks(spark):
    rows = [(f"c{i:02d}", i % 7 if i % 9 else None, i % 3 if i % 5 else None, None if i % 4 else "c01", f"t{i}") for i in range(60)]
    return spark.createDataFrame(rows, CHUNK)


def test_originals(chunks):
    assert selection.originals(chunks).count() == 45
    assert selection.originals(chunks, include_augmented=True).count() == 60


def test_caps_and_mixes_are_repeatable(chunks):
    one = {r.chunk_id for r in selection.capped(chunks, 4, seed=1).collect()}
    assert one == {r.chunk_id for r in selection.capped(chunks.repartition(7), 4, seed=1).collect()}
    assert one != {r.chunk_id for r in selection.capped(chunks, 4, seed=2).collect()}
    assert len(one) == 16  # three collections and those without one
    mixed = selection.weighted_mix(chunks, {0: 3.0, 2: 1.0}, 8).groupBy("source_collection_id").count()
    assert {r[0]: r[1] for r in mixed.collect()} == {0: 6, 2: 2}
    assert selection.weighted_mix(chunks, {0: 1.0}, 10_000).count() == 16


@pytest.mark.parametrize("weights, total", [({}, 5), ({0: 0.0}, 5), ({0: 1.0}, -1)])
def test_bad_mixes_are_refused(chunks, weights, total):
    with pytest.raises(QueryError):
        selection.weighted_mix(chunks, weights, total)


def test_groups_are_cut_before_the_shuffle(chunks):
    plan = selection.capped(chunks, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_compare_counts_null_values(chunks):
    got = {r.value: (r.left_count, r.right_count) for r in selection.compare(chunks, "source_collection_id", "source_id > 3", None).collect()}
    assert sum(b for _, b in got.values()) == 60 and got[None][1] == 12
    with pytest.raises(QueryError):
        selection.compare(chunks, "nothing", None, None)


def test_diff_sees_nulls_and_repeated_rows(spark):
    schema = "chunk_id string, a string, b string"
    old = spark.createDataFrame([("same", None, "x"), ("swap", None, "x"), ("twice", "q", "q"), ("gone", "1", "2"), ("order", "1", "1"), ("order", "2", "2")], schema)
    new = spark.createDataFrame([("same", None, "x"), ("swap", "x", None), ("twice", "q", "q"), ("twice", "q", "q"), ("new", None, None), ("order", "2", "2"), ("order", "1", "1")], schema)
    got = {r.chunk_id: r.change for r in selection.dataset_diff(old, new).collect()}
    assert got == {"swap": "changed", "twice": "changed", "gone": "removed", "new": "added"}


def test_pages_by_key_visit_every_row_once(chunks):
    rows = chunks.where("source_id IS NOT NULL")
    seen, after = [], None
    while True:
        page = explore.query(rows, limit=7, after=after).collect()
        if not page:
            break
        seen += [(r.source_id, r.chunk_id) for r in page]
        after = seen[-1]
    assert seen == sorted((r.source_id, r.chunk_id) for r in rows.collect())
    with pytest.raises(QueryError):
        explore.query(rows, after=(1,))


def test_discarded_tables_are_gone(spark):
    import os

    df = materialize(spark.range(3))
    assert os.path.isdir(df.scratch_path.removeprefix("file:"))
    discard(df)
    assert not os.path.isdir(df.scratch_path.removeprefix("file:"))
    discard(spark.range(1))


def share_out(available, weights, total):
    """Water filling one row at a time: the collection that is farthest below its weight is next."""
    from fractions import Fraction

    got = dict.fromkeys(available, 0)
    open_ = {c for c in available if available[c] and weights[c]}
    left = min(total, sum(available[c] for c in open_))
    while left:
        whole = sum(weights[c] for c in open_)
        full = {c for c in open_ if available[c] * whole <= left * weights[c]}
        for c in full:
            got[c] = available[c]
            left -= available[c]
        open_ -= full
        if not full:
            shares = {c: Fraction(left * weights[c], whole) for c in open_}
            got |= {c: int(x) for c, x in shares.items()}
            spare = left - sum(int(x) for x in shares.values())
            for c in sorted(open_, key=lambda c: (-(shares[c] % 1), c))[:spare]:
                got[c] += 1
            left = 0
    return got


@pytest.mark.parametrize("total", [0, 1, 7, 50, 333, 5000])
@pytest.mark.parametrize("kind", ["equal", "rows", "own"])
def test_quotas_meet_the_total(spark, total, kind):
    import random

    rng = random.Random(total)
    available = {i: rng.choice([0, 1, 2, 5, 40, 300, 1000]) for i in range(25)}
    weights = {i: 1 if kind == "equal" else available[i] if kind == "rows" else rng.choice([0, 1, 3, 29, 71]) for i in available}
    rows = spark.createDataFrame([((i,), n, weights[i]) for i, n in available.items()], "collection struct<id:long>, rows long, weight long")
    got = {r.collection.id: r.quota for r in selection.quotas(rows, total).collect()}
    want = share_out(available, weights, total)
    assert {c: q for c, q in got.items() if q} == {c: q for c, q in want.items() if q}
    assert sum(got.values()) == min(total, sum(n for c, n in available.items() if weights[c]))


def test_samples(spark):
    chunks = spark.range(3000).selectExpr("concat(id, '_0') AS chunk_id", "id AS source_id", "if(id % 3 > 0, 1, if(id % 2 = 0, 2, NULL)) AS source_collection_id")
    count = lambda df: {r.source_collection_id: r["count"] for r in df.groupBy("source_collection_id").count().collect()}
    assert count(selection.sample(chunks, most=100)) == {1: 33, 2: 33, None: 34}
    assert count(selection.sample(chunks, most=100, caps={2: 10})) == {1: 45, 2: 10, None: 45}
    assert count(selection.sample(chunks, most=100, strategy="stratified")) == {1: 67, 2: 16, None: 17}
    assert count(selection.sample(chunks, most=100, weights={1: 0.29, 2: 0.71})) == {1: 29, 2: 71}
    assert count(selection.sample(chunks, most=1000, weights={1: 0.29, 2: 0.71})) == {1: 500, 2: 500}
    assert count(selection.sample(chunks, caps={1: 4, 2: 0})) == {1: 4, None: 500}
    assert [r.source_id for r in selection.sample(chunks, most=3, caps={2: 0}, strategy="none").orderBy("source_id").collect()] == [1, 2, 3]
    once = {r.chunk_id for r in selection.sample(chunks, most=50).collect()}
    assert once == {r.chunk_id for r in selection.sample(chunks.repartition(7), most=50).collect()} != {r.chunk_id for r in selection.sample(chunks, most=50, seed=1).collect()}
    for bad in ({"strategy": "x"}, {"most": -1}, {"weights": {1: 1}}, {"most": 1, "weights": {1: 0}}):
        with pytest.raises(QueryError):
            selection.sample(chunks, **bad)


def test_decimal_weights_are_exact(spark):
    chunks = spark.range(400).selectExpr("concat(id, '_0') AS chunk_id", "id AS source_id", "id % 2 AS source_collection_id")
    got = {r.source_collection_id: r["count"] for r in selection.weighted_mix(chunks, {0: 0.29, 1: 0.71}, 100).groupBy("source_collection_id").count().collect()}
    assert got == {0: 29, 1: 71}


def test_an_added_column_is_a_change(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, text string")
    new = spark.createDataFrame([("a", "x", 1), ("b", "y", None), ("d", "w", 2)], "chunk_id string, text string, n long")
    diff = lambda a, b: {tuple(r) for r in selection.dataset_diff(a, b).collect()}
    assert diff(old, new) == {("a", "changed"), ("c", "removed"), ("d", "added")}
    assert diff(new, old) == {("a", "changed"), ("c", "added"), ("d", "removed")}
    assert diff(old, old) == set()
