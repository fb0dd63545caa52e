"""Catalog queries: visibility, versions, canonical variants, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.plans import catalog
from workload import tables
from workload.registry import CHUNKS, query

SOURCES = f"""sources AS (SELECT doc_id AS id, 'doc_' || doc_id AS original_name,
    nullif(CAST(substr(source, 4) AS BIGINT), {tables.NO_COLLECTION}) AS collection_id, n_chars AS size
  FROM documents),
collections AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id,
                       CAST(substr(source, 4) AS BIGINT) % 3 AS owner_id FROM documents)"""
VISIBLE = """visible AS (SELECT s.* FROM sources s LEFT JOIN collections c ON c.id = s.collection_id
  WHERE c.owner_id = 1 OR s.collection_id IS NULL)"""
VARIANTS = """variants AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS source_id,
    l_returnflag AS extractor_name, l_linestatus AS config_hash, l_linenumber = 1 AS is_canonical,
    l_linenumber AS n FROM lineitem)"""
DATASETS = """datasets AS (SELECT o_orderkey AS id, o_custkey AS recipe_id,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'pending' END AS status,
    CASE WHEN o_orderstatus = 'O' THEN 100 END AS sample_count,
    CASE WHEN o_orderstatus = 'O' THEN 5000 END AS size_bytes,
    CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS materialized_at FROM orders)"""
DEFINITION = """'{"segment":"' || c_mktsegment || '"}'"""


@query(f"WITH {SOURCES}, {VISIBLE} SELECT id, original_name, size FROM visible")
def visible_sources(spark: SparkSession, sf: str) -> DataFrame:
    seen = catalog.visible_sources(tables.sources(spark, sf), tables.collections(spark, sf), 1)
    return seen.select("id", "original_name", "size")


@query(f"""WITH {SOURCES}, {VISIBLE}, {VARIANTS}
SELECT v.id, v.source_id, v.extractor_name FROM variants v
WHERE v.source_id IN (SELECT id FROM visible)""")
def visible_variants(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.visible_variants(
        tables.variants(spark, sf), tables.sources(spark, sf), tables.collections(spark, sf), 1
    ).select("id", "source_id", "extractor_name")


@query("""SELECT DISTINCT o_custkey AS id FROM orders
WHERE o_custkey NOT IN (SELECT doc_id FROM documents)""")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    asked = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return catalog.missing_ids(asked, tables.sources(spark, sf))


@query("""SELECT DISTINCT 'chunks' AS asset, o_custkey AS source_id, 'src_' || o_custkey AS partition_key
FROM orders WHERE o_custkey IN (SELECT doc_id FROM documents)""")
def run_requests(spark: SparkSession, sf: str) -> DataFrame:
    asked = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return catalog.run_requests(asked, tables.sources(spark, sf), "chunks")


@query("""SELECT p_partkey AS id, p_brand AS category FROM part WHERE p_size % 3 <> 0 AND p_brand = 'Brand#2'""")
def active_operators(spark: SparkSession, sf: str) -> DataFrame:
    operators = tables.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("category"),
        F.expr("CASE p_size % 3 WHEN 0 THEN false WHEN 1 THEN true END").alias("is_active"),
    )
    return catalog.active_operators(operators, "Brand#2").select("id", "category")


@query(f"""WITH {VARIANTS}, chosen AS (SELECT source_id, max(id) AS id FROM variants
  WHERE extractor_name = 'R' GROUP BY source_id)
SELECT v.id, v.source_id, v.extractor_name,
       CASE WHEN c.id IS NULL THEN v.is_canonical ELSE v.id = c.id END AS is_canonical
FROM variants v LEFT JOIN chosen c ON c.source_id = v.source_id""")
def canonical_variant(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.set_canonical(tables.variants(spark, sf), "R").drop("config_hash")


@query(f"""WITH {VARIANTS},
existing AS (SELECT id, source_id, extractor_name, config_hash, n = 2 AND source_id % 2 = 0 AS is_canonical
             FROM variants WHERE n IN (2, 3)),
fresh AS (SELECT min(id) AS id, source_id, extractor_name, config_hash FROM variants
          WHERE n NOT IN (2, 3) GROUP BY ALL),
added AS (SELECT f.* FROM fresh f ANTI JOIN existing e ON e.source_id = f.source_id
          AND e.extractor_name = f.extractor_name AND e.config_hash = f.config_hash),
first AS (SELECT source_id, min(id) AS id FROM added
          WHERE source_id NOT IN (SELECT source_id FROM existing WHERE is_canonical) GROUP BY source_id)
SELECT id, source_id, extractor_name, config_hash, is_canonical FROM existing
UNION ALL
SELECT a.id, a.source_id, a.extractor_name, a.config_hash, coalesce(a.id = f.id, false)
FROM added a LEFT JOIN first f ON f.source_id = a.source_id""")
def insert_variants(spark: SparkSession, sf: str) -> DataFrame:
    every = tables.variants(spark, sf).withColumn("n", F.col("id") % 8)
    existing = every.where("n IN (2, 3)").withColumn(
        "is_canonical", F.expr("n = 2 AND source_id % 2 = 0")
    )
    return catalog.insert_variants(existing.drop("n"), every.where("n NOT IN (2, 3)").drop("n"))


@query(f"""WITH {DATASETS}
SELECT c.c_custkey AS recipe_id, 'v' || (count(d.id) + 1) AS version_tag,
       'ds_' || c.c_custkey || '_v' || (count(d.id) + 1) AS partition_key
FROM customer c LEFT JOIN datasets d ON d.recipe_id = c.c_custkey GROUP BY c.c_custkey""")
def next_version(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.next_versions(tables.recipes(spark, sf), tables.datasets(spark, sf))


@query(f"""WITH {DATASETS}
SELECT c_custkey + 1000000 AS id, c_custkey AS recipe_id, 'v' || (n + 1) AS version_tag,
       's3://datasets/' || (c_custkey + 1000000) || '_v' || (n + 1) AS hf_repo_uri,
       {DEFINITION} AS recipe_snapshot, 'pending' AS status
FROM (SELECT c_custkey, c_mktsegment, count(d.id) AS n FROM customer
      LEFT JOIN datasets d ON d.recipe_id = c_custkey GROUP BY ALL)""")
def new_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.new_datasets(tables.recipes(spark, sf), tables.datasets(spark, sf), 1000000)


@query(f"""WITH {DATASETS}
SELECT c_custkey AS id FROM customer
WHERE c_custkey IN (SELECT recipe_id FROM datasets WHERE status <> 'failed')""")
def recipe_freeze(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.locked_recipes(tables.recipes(spark, sf), tables.datasets(spark, sf)).select("id")


@query(f"""WITH {DATASETS}, locked AS (SELECT DISTINCT recipe_id FROM datasets WHERE status <> 'failed'),
r AS (SELECT c_custkey AS id, {DEFINITION} AS old, c_acctbal < 2000 AS asked,
             c_custkey IN (SELECT recipe_id FROM locked) AS locked FROM customer)
SELECT id, CASE WHEN asked AND NOT locked THEN '{{}}' ELSE old END AS definition,
       CASE WHEN asked AND NOT locked THEN 'updated' WHEN asked THEN 'locked' ELSE 'unchanged' END AS outcome
FROM r""")
def recipe_update(spark: SparkSession, sf: str) -> DataFrame:
    changes = tables.table(spark, sf, "customer").where("c_acctbal < 2000").select(
        F.col("c_custkey").alias("id"), F.lit("{}").alias("definition")
    )
    return catalog.update_recipes(
        tables.recipes(spark, sf), tables.datasets(spark, sf), changes
    ).select("id", "definition", "outcome")


@query(f"""WITH {DATASETS}, f AS (SELECT o_orderkey AS id, o_orderkey % 50 AS n FROM orders
  WHERE o_orderkey % 3 = 0)
SELECT d.id, CASE WHEN f.id IS NOT NULL AND d.status = 'pending' THEN 'done' ELSE d.status END AS status,
       CAST(CASE WHEN f.id IS NOT NULL AND d.status = 'pending' THEN f.n ELSE d.sample_count END AS VARCHAR)
         AS sample_count,
       CAST(CASE WHEN f.id IS NOT NULL AND d.status = 'pending' THEN f.n * 10 ELSE d.size_bytes END AS VARCHAR)
         AS size_bytes,
       CASE WHEN f.id IS NOT NULL AND d.status = 'pending' THEN '2024-02-01'
            ELSE strftime(d.materialized_at, '%Y-%m-%d') END AS materialized_on
FROM datasets d LEFT JOIN f ON f.id = d.id""")
def dataset_done(spark: SparkSession, sf: str) -> DataFrame:
    finished = tables.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("dataset_id"),
        (F.col("o_orderkey") % 50).alias("sample_count"),
        (F.col("o_orderkey") % 50 * 10).alias("size_bytes"),
    )
    done = catalog.mark_done(
        tables.datasets(spark, sf), finished, F.lit("2024-02-01").cast("timestamp")
    )
    return done.select(
        "id",
        "status",
        F.col("sample_count").cast("string"),
        F.col("size_bytes").cast("string"),
        F.date_format("materialized_at", "yyyy-MM-dd").alias("materialized_on"),
    )


@query(f"""WITH {DATASETS} SELECT id, recipe_id, status FROM datasets
ORDER BY materialized_at DESC NULLS LAST, id DESC LIMIT 200 OFFSET 100""")
def catalog_order(spark: SparkSession, sf: str) -> DataFrame:
    page = catalog.listing(tables.datasets(spark, sf), "datasets", 200, 100)
    return page.select("id", "recipe_id", "status")


@query(f"""WITH {DATASETS}, o AS (SELECT *, row_number() OVER (ORDER BY materialized_at DESC NULLS LAST, id DESC) AS n FROM datasets)
SELECT id, recipe_id, status FROM o WHERE n > 100 AND n <= 300""")
def catalog_after(spark: SparkSession, sf: str) -> DataFrame:
    """The page behind the hundredth row, reached by that row's values."""
    rows = tables.datasets(spark, sf)
    last = catalog.listing(rows, "datasets", 1, 99).first()
    page = catalog.listing(rows, "datasets", 200, after=(last.materialized_at, last.id))
    return page.select("id", "recipe_id", "status")


@query("""SELECT c_custkey AS id FROM customer ORDER BY c_custkey % 97 DESC, c_custkey DESC LIMIT 100""")
def recipe_order(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listing(tables.recipes(spark, sf), "recipes", 100).select("id")


@query("""SELECT user_id AS id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error'
GROUP BY user_id ORDER BY max(ts) DESC, id DESC LIMIT 50""")
def failed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one status, latest first."""
    runs = tables.table(spark, sf, "events").groupBy(
        F.col("user_id").alias("id"),
        F.when(F.col("event_type") == "error", "failure").otherwise("other").alias("status"),
    ).agg(F.max("ts").alias("started_at"), F.count(F.lit(1)).alias("n"))
    return catalog.listing(runs, "runs", 50, status="failure").select("id", "n")


@query(f"""WITH {CHUNKS}
SELECT source_collection_id,
       round(sum(CASE WHEN source_id % 3 = 0 THEN 0.0
                      ELSE (token_count * 0.25 + 100 * 1.25) / 1000000 END), 8) AS cost_usd
FROM chunks GROUP BY source_collection_id""")
def call_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of one call per chunk; some go to a model without a price."""
    model = F.when(F.col("source_id") % 3 == 0, "unknown").otherwise(next(iter(catalog.PRICES)))
    cost = catalog.call_cost(model, F.col("token_count"), F.lit(100))
    return tables.chunks(spark, sf).groupBy("source_collection_id").agg(
        F.round(F.sum(cost), 8).alias("cost_usd")
    )
