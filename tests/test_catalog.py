from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chunkloom.plans import catalog

VARIANT = "id bigint, source_id bigint, extractor_name string, config_hash string, is_canonical boolean"
DATASET = "id bigint, recipe_id bigint, status string, sample_count bigint, size_bytes bigint, materialized_at timestamp"


def test_visibility(spark):
    collections = spark.createDataFrame([(1, 10), (2, 20)], "id bigint, owner_id bigint")
    sources = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 99)], "id bigint, collection_id bigint")
    assert sorted(r.id for r in catalog.visible_sources(sources, collections, 10).collect()) == [1, 3]
    variants = spark.createDataFrame([(7, 1, "a", "h", True), (8, 2, "a", "h", True)], VARIANT)
    assert [r.id for r in catalog.visible_variants(variants, sources, collections, 10).collect()] == [7]


def test_set_canonical(spark):
    rows = [(1, 1, "a", "h", True), (2, 1, "b", "h", False), (3, 1, "b", "i", False), (4, 2, "a", "h", True), (5, 3, "b", "h", False)]
    got = {r.id: r.is_canonical for r in catalog.set_canonical(spark.createDataFrame(rows, VARIANT), "b").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_insert_variants(spark):
    old = spark.createDataFrame([(1, 1, "a", "h", True), (2, 2, "a", "h", False)], VARIANT)
    new = spark.createDataFrame([(10, 1, "a", "h", None), (11, 1, "b", "h", None), (12, 2, "a", "h", None), (13, 2, "b", "h", None), (14, 3, "a", "h", None), (15, 3, "b", "h", None)], VARIANT)
    got = {r.id: r.is_canonical for r in catalog.insert_variants(old, new).collect()}
    assert got == {1: True, 2: False, 11: False, 13: True, 14: True, 15: False}
    again = catalog.insert_variants(catalog.insert_variants(old, new), new)
    assert {r.id: r.is_canonical for r in again.collect()} == got


def test_versions_and_freeze(spark):
    recipes = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d3")], "id bigint, definition string")
    data = spark.createDataFrame([(1, 1, "failed"), (2, 1, "failed"), (3, 2, "pending"), (4, 2, "failed")], "id bigint, recipe_id bigint, status string")
    got = {r.recipe_id: (r.version_tag, r.partition_key) for r in catalog.next_versions(recipes, data).collect()}
    assert got == {1: ("v3", "ds_1_v3"), 2: ("v3", "ds_2_v3"), 3: ("v1", "ds_3_v1")}
    assert [r.id for r in catalog.locked_recipes(recipes, data).collect()] == [2]
    changes = spark.createDataFrame([(1, "new"), (2, "new")], "id bigint, definition string")
    done = {r.id: (r.definition, r.outcome) for r in catalog.update_recipes(recipes, data, changes).collect()}
    assert done == {1: ("new", "updated"), 2: ("d2", "locked"), 3: ("d3", "unchanged")}
    fresh = {r.recipe_id: r for r in catalog.new_datasets(recipes, data, 100).collect()}
    assert fresh[1].recipe_snapshot == "d1" and fresh[1].hf_repo_uri == "s3://datasets/101_v3" and fresh[1].status == "pending"


def test_status_updates(spark):
    then = datetime(2024, 1, 1)
    data = spark.createDataFrame([(1, 1, "pending", None, None, None), (2, 1, "done", 5, 6, then), (3, 1, "failed", None, None, None)], DATASET)
    finished = spark.createDataFrame([(i, 9, 90) for i in (1, 2, 3)], "dataset_id bigint, sample_count bigint, size_bytes bigint")
    got = {r.id: (r.status, r.sample_count, r.size_bytes) for r in catalog.mark_done(data, finished).collect()}
    assert got == {1: ("done", 9, 90), 2: ("done", 5, 6), 3: ("failed", None, None)}
    bad = catalog.mark_failed(data, spark.createDataFrame([(1,)], "dataset_id bigint"))
    assert {r.id: r.status for r in bad.collect()} == {1: "failed", 2: "done", 3: "failed"}


def test_listing_orders(spark):
    day = lambda d: datetime(2024, 1, d)
    runs = spark.createDataFrame([(1, day(1), "success"), (2, None, "pending"), (3, day(2), "success"), (4, day(2), "failure")], "id bigint, started_at timestamp, status string")
    assert [r.id for r in catalog.listing(runs, "runs", 10).collect()] == [4, 3, 1, 2]
    assert [r.id for r in catalog.listing(runs, "runs", 1, 1, "success").collect()] == [1]


def test_operators_missing_ids_and_requests(spark):
    ops = spark.createDataFrame([(3, "t", None), (1, "t", True), (2, "t", False), (4, "x", None)], "id bigint, category string, is_active boolean")
    assert [r.id for r in catalog.active_operators(ops, "t").collect()] == [1, 3]
    assert catalog.active_operators(ops, "none").count() == 0
    asked, have = spark.createDataFrame([(1,), (1,), (9,)], "id bigint"), spark.createDataFrame([(1,), (2,)], "id bigint")
    assert [r.id for r in catalog.missing_ids(asked, have).collect()] == [9]
    assert [r.partition_key for r in catalog.run_requests(asked, have, "chunks").collect()] == ["src_1"]


def test_call_cost(spark):
    model = next(iter(catalog.PRICES))
    df = spark.createDataFrame([(model, 1_000_000, 2_000_000), ("other", 5, 5)], "m string, i bigint, o bigint")
    assert [r[0] for r in df.select(catalog.call_cost(F.col("m"), F.col("i"), F.col("o"))).collect()] == [2.75, 0.0]


def test_pages_behind_a_key(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(i, day(1 + i % 4) if i % 5 else None) for i in range(1, 41)]
    runs = spark.createDataFrame(rows, "id long, started_at timestamp")
    whole = [(r.id, r.started_at) for r in catalog.listing(runs, "runs", 100).collect()]
    seen, after = [], None
    while True:
        page = [(r.id, r.started_at) for r in catalog.listing(runs, "runs", 7, after=after).collect()]
        if not page:
            break
        seen += page
        after = (page[-1][1], page[-1][0])
    assert seen == whole and len(whole) == 40
    assert [r.id for r in catalog.listing(runs, "sources", 3, after=(37,)).collect()] == [38, 39, 40]
    with pytest.raises(ValueError):
        catalog.listing(runs, "runs", 3, after=(1,))
