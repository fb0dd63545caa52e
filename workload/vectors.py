"""Vector search over all embeddings; queries are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.operators.vectors import VectorIndex
from chunkloom.session import scratch_path
from workload import tables
from workload.registry import query

K = 10
NAMES = {"key": "vec_id", "vector": "embedding"}


def search(spark: SparkSession, sf: str, **options) -> DataFrame:
    rows = tables.table(spark, sf, "embeddings")
    index = VectorIndex.build(rows, scratch_path(spark, "vectors"), k=K, **NAMES)
    return index.search(rows.where("vec_id % 50 = 0"), K, **NAMES, **options)


@query()
def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return search(spark, sf)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS score
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score
FROM s QUALIFY rank <= 10""")
def vector_top_k_exact(spark: SparkSession, sf: str) -> DataFrame:
    return search(spark, sf, probes=None)
