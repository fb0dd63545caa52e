"""One key with most of the rows: results stay whole, joins are split."""

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import minhash
from chunkloom.plans import lineage, skew
from chunkloom.plans.components import connected_components
from chunkloom.plans.skew import join_salted
from chunkloom.session import tune

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_tasks(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    tune(spark)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_parent_is_split(spark, small_tasks):
    ids = spark.range(0, 20000, 1, 16)
    nodes = ids.select(
        F.format_string("c%05d", "id").alias("chunk_id"),
        F.lit(1).cast("bigint").alias("source_id"),
        F.when(F.col("id") > 0, F.when(F.col("id") % 3 > 0, "c00000").otherwise(F.format_string("c%05d", F.col("id") - 1))).alias("augmented_from"),
    )
    found = lineage.chains(nodes).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in found} == {"ok": 20000}


def test_skewed_lookup_is_split(spark, small_tasks):
    nodes = spark.range(0, 30000, 1, 16).select(
        F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"),
        F.lit(1).cast("bigint").alias("source_id"),
        F.when(F.col("id") > 0, F.sha2(F.when(F.col("id") % 3 > 0, F.lit("0")).otherwise(F.lit("1")), 256)).alias("augmented_from"),
    )
    step = lineage._first_steps(nodes)
    assert len(step.collect()) == 29999
    assert "skew=true" in step._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows_per_copy", [10, 333, 10**6])
def test_salted_join_equals_plain_join(spark, rows_per_copy):
    many = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    one = many.groupBy("k").agg(F.sum("id").alias("s"), F.count(F.lit(1)).alias("n"))
    got = join_salted(many, one, "k", F.col("id"), rows_per_copy=rows_per_copy)
    want = many.join(one.drop("n"), "k")
    assert sorted(map(tuple, got.select("k", "id", "s").collect())) == sorted(map(tuple, want.select("k", "id", "s").collect()))
    lonely = join_salted(many, one.where("k <> 7"), "k", F.col("id"), how="left", rows_per_copy=rows_per_copy)
    assert lonely.count() == 3000 and lonely.where("s IS NULL").count() == many.where("k = 7").count()


def test_hub_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_COPY", 50)
    edges = spark.range(1, 2000).select(F.format_string("n%04d", "id").alias("hi"), F.when(F.col("id") % 5 > 0, "n0000").otherwise(F.format_string("n%04d", F.col("id") - 1)).alias("lo"))
    got = connected_components(edges).collect()
    assert len(got) == 1999 and {r.root for r in got} == {"n0000"}


def test_most_texts_are_copies(spark):
    rows = [(f"{i % 2}_{i:04d}", i % 2, "the very same text again" if i % 3 else f"text number {i} of its own") for i in range(1200)]
    got = minhash.tag_near_duplicates(spark.createDataFrame(rows, "chunk_id string, source_id bigint, text string")).collect()
    assert len(got) == 1200
    for source in (0, 1):
        own = [r for r in got if r.source_id == source]
        heads = [r for r in own if r.attr_minhash_is_head]
        assert len(heads) == 1 + 200
        assert sorted(r.attr_minhash_cluster_id for r in heads) == list(range(201))
        assert [r.attr_minhash_cluster_id for r in sorted(heads, key=lambda r: r.chunk_id)] == list(range(201))
        copies = {r.attr_minhash_cluster_id for r in own if int(r.chunk_id[2:]) % 3}
        assert len(copies) == 1
