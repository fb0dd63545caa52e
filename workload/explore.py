"""Queries on chunks and on plain tables: pages, look-ups, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.plans import explore
from chunkloom.plans.filters import where
from chunkloom.session import materialize
from workload import tables
from workload.registry import CHUNKS, query

PAGE = (
    "token_count BETWEEN 100 AND 400 AND lower(text) LIKE '%the%'"
    " AND source_collection_id NOT IN (3, 7) AND length(text) > 500"
)


@query(f"""WITH {CHUNKS}
SELECT chunk_id, source_id, source_collection_id, 'chunks' AS producer_asset,
       '0.1.0' AS producer_version, text, token_count, '' AS docling_refs, '' AS source_refs
FROM chunks""")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return tables.chunks(spark, sf).select(
        "chunk_id", "source_id", "source_collection_id", "producer_asset", "producer_version",
        "text", "token_count", "docling_refs", "source_refs",
    )


@query(f"""WITH {CHUNKS}
SELECT lang AS attr_lang_code, count(*) AS count,
       round(avg(token_count), 6) AS mean_token_count
FROM chunks GROUP BY lang""")
def chunk_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf, "lang")
    chunks = fixed_size_chunks(docs, carry=("lang",)).withColumn("attr_lang_code", F.col("lang"))
    out = explore.aggregate(chunks, "attr_lang_code", ["count", "mean:token_count"])
    return out.withColumn("mean_token_count", F.round("mean_token_count", 6))


@query(f"""WITH {CHUNKS}
SELECT chunk_id, source_id, token_count, CAST(NULL AS VARCHAR) AS text
FROM chunks WHERE {PAGE} ORDER BY source_id, chunk_id LIMIT 50 OFFSET 20""")
def chunk_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    page = explore.query(
        tables.chunks(spark, sf), PAGE, ["source_id", "token_count"], limit=50, offset=20
    )
    return page.select("chunk_id", "source_id", "token_count", "text")


@query(f"WITH {CHUNKS} SELECT count(*) AS total FROM chunks WHERE {PAGE}")
def chunk_total(spark: SparkSession, sf: str) -> DataFrame:
    return explore.total(tables.chunks(spark, sf), PAGE)


@query(f"""WITH {CHUNKS},
asked AS (SELECT doc_id || '_0' AS chunk_id FROM labels
          UNION SELECT doc_id || '_1' FROM labels)
SELECT a.chunk_id, CAST(c.source_id AS VARCHAR) AS source_id,
       CAST(c.token_count AS VARCHAR) AS token_count, c.chunk_id IS NOT NULL AS found
FROM asked a LEFT JOIN chunks c ON a.chunk_id = c.chunk_id""")
def chunk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    labels = tables.table(spark, sf, "labels")
    asked = labels.select(
        F.explode(
            F.array(F.concat("doc_id", F.lit("_0")), F.concat("doc_id", F.lit("_1")))
        ).alias("chunk_id")
    )
    return explore.lookup_many(tables.chunks(spark, sf), asked).select(
        "chunk_id",
        F.col("source_id").cast("string"),
        F.col("token_count").cast("string"),
        "found",
    )


@query(f"""WITH {CHUNKS}
SELECT source_collection_id, count(*) AS count, CAST(sum(token_count) AS BIGINT) AS sum_token_count,
       round(avg(token_count), 6) AS mean_token_count, min(token_count) AS min_token_count,
       max(chunk_id) AS max_chunk_id, min(text) AS min_text
FROM chunks WHERE token_count > 20 GROUP BY source_collection_id""")
def chunk_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    out = explore.aggregate(
        tables.chunks(spark, sf),
        "source_collection_id",
        ["count", "sum:token_count", "mean:token_count", "min:token_count", "max:chunk_id", "min:text"],
        "token_count > 20",
    )
    return out.withColumn("mean_token_count", F.round("mean_token_count", 6))


@query("""SELECT CAST(l.quality AS VARCHAR) AS quality, count(*) AS count, round(avg(d.n_chars), 6) AS mean_n_chars,
       max(d.n_chars) AS max_n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality""")
def agg_null_group(spark: SparkSession, sf: str) -> DataFrame:
    out = explore.aggregate(
        tables.labelled(spark, sf), "quality", ["count", "mean:n_chars", "max:n_chars"]
    )
    return out.withColumns(
        {"quality": F.col("quality").cast("string"), "mean_n_chars": F.round("mean_n_chars", 6)}
    )


@query("""SELECT l_returnflag, count(*) AS count, sum(l_quantity) AS sum_l_quantity,
       round(avg(l_extendedprice), 4) AS mean_l_extendedprice, min(l_discount) AS min_l_discount,
       max(l_tax) AS max_l_tax
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag""")
def lineitem_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    out = explore.aggregate(
        tables.table(spark, sf, "lineitem"),
        "l_returnflag",
        ["count", "sum:l_quantity", "mean:l_extendedprice", "min:l_discount", "max:l_tax"],
        "l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'",
    )
    return out.withColumn("mean_l_extendedprice", F.round("mean_l_extendedprice", 4))


def histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""WITH v AS (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
e AS (SELECT i, CASE WHEN i = {bins} THEN hi ELSE lo + (hi - lo) / {bins} * i END AS edge
      FROM b, range(0, {bins + 1}) r(i)),
k AS (SELECT l.i, l.edge AS lower, h.edge AS upper FROM e l JOIN e h ON h.i = l.i + 1)
SELECT CAST(k.i AS INTEGER) AS bucket, k.lower AS lower, k.upper AS upper, count(v.x) AS count
FROM k LEFT JOIN v ON v.x >= k.lower AND (v.x < k.upper OR (k.i = {bins - 1} AND v.x <= k.upper))
GROUP BY ALL"""


@query(histogram_sql("documents", "n_chars", 10))
def hist_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return explore.numeric_distribution(tables.table(spark, sf, "documents"), "n_chars", 10)


@query(histogram_sql("lineitem", "l_extendedprice", 25))
def hist_price(spark: SparkSession, sf: str) -> DataFrame:
    return explore.numeric_distribution(tables.table(spark, sf, "lineitem"), "l_extendedprice", 25)


@query("""SELECT CAST(l.quality AS VARCHAR) AS value, count(*) AS count
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality""")
def hist_categorical(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.labelled(spark, sf).withColumn("quality", F.col("quality").cast("string"))
    return explore.categorical_distribution(rows, "quality")


@query(f"WITH {CHUNKS}, "
       + histogram_sql("(SELECT token_count FROM chunks WHERE source_id >= 0)", "token_count", 10)[5:])
def chunk_distribution(spark: SparkSession, sf: str) -> DataFrame:
    # Two passes follow, so the chunks are cut once and the two columns kept.
    sizes = materialize(tables.chunks(spark, sf).select("source_id", "token_count"), "sizes")
    return explore.distribution(sizes, "token_count", 10, "source_id >= 0")


@query("""SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events WHERE json_extract_string(props, '$.k') IN ('42', '7')
   OR (event_type NOT IN ('click', 'view') AND json_extract_string(props, '$.k') LIKE '9%'
       AND value BETWEEN 1 AND 20)""")
def json_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = where(
        tables.table(spark, sf, "events"),
        "props->>'k' IN ('42', '7') OR (event_type NOT IN ('click', 'view')"
        " AND props->>'k' LIKE '9%' AND value BETWEEN 1 AND 20)",
    )
    return rows.select(
        "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
