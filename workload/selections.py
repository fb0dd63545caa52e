"""Selection queries: originals, sources, samples, mixes, comparisons, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.synthesis import split_of
from chunkloom.plans import explore, selection
from workload import tables
from workload.recipes import _bucket_sql
from workload.registry import CHUNKS, query

COLUMNS = ["chunk_id", "source_id", "source_collection_id"]


@query("""SELECT 'n' || doc_id AS chunk_id FROM documents
WHERE doc_id % 40 = 0 AND (doc_id // 40) % 5 NOT IN (1, 2)""")
def original_only(spark: SparkSession, sf: str) -> DataFrame:
    return selection.originals(tables.derived_chunks(spark, sf)).select("chunk_id")


@query(f"""WITH {CHUNKS}
SELECT chunk_id, source_id, source_collection_id FROM chunks JOIN documents d ON d.doc_id = source_id
WHERE d.n_chars < 3000 AND d.lang <> 'fr' AND source_collection_id IN (0, 2, 5)""")
def chunks_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    return selection.of_sources(
        tables.chunks(spark, sf), tables.sources(spark, sf), "size < 3000 AND lang <> 'fr'", [0, 2, 5]
    ).select(*COLUMNS)


@query(f"""WITH {CHUNKS}
SELECT chunk_id, source_id, source_collection_id FROM chunks
QUALIFY row_number() OVER (PARTITION BY source_collection_id ORDER BY md5('7:' || chunk_id), chunk_id) <= 5""")
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    return selection.capped(tables.chunks(spark, sf), 5, seed=7).select(*COLUMNS)


@query(f"""WITH {CHUNKS}
SELECT chunk_id, source_id, source_collection_id FROM chunks
QUALIFY row_number() OVER (PARTITION BY source_collection_id ORDER BY md5('3:' || chunk_id), chunk_id)
     <= CASE source_collection_id WHEN 0 THEN 25 WHEN 1 THEN 12 WHEN 4 THEN 12 ELSE 0 END""")
def weighted_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = selection.weighted_mix(tables.chunks(spark, sf), {0: 2.0, 1: 1.0, 4: 1.0}, 50, seed=3)
    return mixed.select(*COLUMNS)


CAPS = {0: 30, 3: 10, 7: 5}
_CAPPED = """k AS (SELECT *, CASE source_collection_id WHEN 0 THEN 30 WHEN 3 THEN 10 WHEN 7 THEN 5 ELSE 1000000000 END AS cap FROM chunks),
r AS (SELECT chunk_id, source_id, source_collection_id AS c, row_number() OVER (PARTITION BY source_collection_id ORDER BY {order}) AS n
      FROM k QUALIFY n <= cap),
a AS (SELECT c, count(*) AS a FROM r GROUP BY c)"""
_DRAWN = _CAPPED.format(order="md5('42:' || chunk_id), chunk_id")
_CHOSEN = "SELECT chunk_id, source_id, c AS source_collection_id FROM r JOIN q USING (c) WHERE n <= quota"


@query(f"""WITH {CHUNKS}, {_DRAWN},
level AS (SELECT max(l) AS l FROM (SELECT l, sum(least(a, l)) AS s FROM a, (SELECT unnest(range(0, 301)) AS l) GROUP BY l) WHERE s <= 300),
q AS (SELECT c, least(a, l) + CASE WHEN a > l AND row_number() OVER (PARTITION BY a > l ORDER BY c) <= 300 - (SELECT sum(least(a, l)) FROM a, level)
             THEN 1 ELSE 0 END AS quota FROM a, level)
{_CHOSEN}""")
def sample_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return selection.sample(tables.chunks(spark, sf), most=300, caps=CAPS).select(*COLUMNS)


@query(f"""WITH {CHUNKS}, {_DRAWN},
s AS (SELECT c, a, (300 * a) // sum(a) OVER () AS w, (300 * a) % sum(a) OVER () AS o FROM a),
q AS (SELECT c, w + CASE WHEN row_number() OVER (ORDER BY o DESC, c) <= 300 - sum(w) OVER () THEN 1 ELSE 0 END AS quota FROM s)
{_CHOSEN}""")
def sample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return selection.sample(tables.chunks(spark, sf), most=300, caps=CAPS, strategy="stratified").select(*COLUMNS)


@query(f"""WITH {CHUNKS}, {_CAPPED.format(order="source_id, chunk_id")}
SELECT chunk_id, source_id, c AS source_collection_id FROM r ORDER BY source_id, chunk_id LIMIT 300""")
def sample_first(spark: SparkSession, sf: str) -> DataFrame:
    return selection.sample(tables.chunks(spark, sf), most=300, caps=CAPS, strategy="none").select(*COLUMNS)


@query(f"""WITH {CHUNKS}
SELECT source_collection_id AS value, count(*) FILTER (token_count > 300) AS left_count,
       count(*) FILTER (text LIKE '%the%') AS right_count
FROM chunks WHERE token_count > 300 OR text LIKE '%the%' GROUP BY 1""")
def compare_filters(spark: SparkSession, sf: str) -> DataFrame:
    return selection.compare(
        tables.chunks(spark, sf), "source_collection_id", "token_count > 300", "text LIKE '%the%'"
    )


@query(f"""WITH {CHUNKS},
s AS (SELECT *, CASE WHEN {_bucket_sql("chunk_id")} < 20 THEN 'validation' ELSE 'train' END AS split FROM chunks)
SELECT split, count(*) AS rows, count(token_count) AS n_token_count, round(avg(token_count), 6) AS mean_token_count,
       min(token_count) AS min_token_count, max(token_count) AS max_token_count FROM s GROUP BY split""")
def split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.chunks(spark, sf).withColumn("split", split_of(F.col("chunk_id"), 0.2))
    return selection.split_statistics(rows, ["token_count"]).withColumn("mean_token_count", F.round("mean_token_count", 6))


@query(f"""WITH {CHUNKS},
o AS (SELECT chunk_id, text FROM chunks WHERE token_count > 100),
n AS (SELECT chunk_id, CASE WHEN token_count > 400 THEN upper(text) ELSE text END AS text FROM chunks WHERE source_id % 3 > 0)
SELECT chunk_id, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n USING (chunk_id) WHERE o.text IS DISTINCT FROM n.text""")
def dataset_diff(spark: SparkSession, sf: str) -> DataFrame:
    chunks = tables.chunks(spark, sf)
    old = chunks.where("token_count > 100").select("chunk_id", "text")
    new = chunks.where("source_id % 3 > 0").select(
        "chunk_id", F.expr("CASE WHEN token_count > 400 THEN upper(text) ELSE text END").alias("text")
    )
    return selection.dataset_diff(old, new)


@query(f"""WITH {CHUNKS}
SELECT chunk_id, source_id, token_count FROM chunks
WHERE token_count > 20 AND (source_id > 50 OR (source_id = 50 AND chunk_id > '50_0'))
ORDER BY source_id, chunk_id LIMIT 40""")
def page_after_key(spark: SparkSession, sf: str) -> DataFrame:
    page = explore.query(
        tables.chunks(spark, sf), "token_count > 20", ["source_id", "token_count"], limit=40, after=(50, "50_0")
    )
    return page.select("chunk_id", "source_id", "token_count")
