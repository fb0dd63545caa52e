"""Queries through the sinks and sources: chunk table, documents, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.operators.markdown import render_markdown
from chunkloom.operators.quality import tag_quality_by_length
from chunkloom.session import scratch_path
from chunkloom.sources import documents as document_store
from chunkloom.sources import files
from chunkloom.sources.chunk_table import ChunkTable, merge_columns
from chunkloom.streaming.ingest import backfill
from workload import tables
from workload.registry import CHUNKS, chunks_cte, query


def new_table(spark: SparkSession, label: str) -> ChunkTable:
    return ChunkTable(spark, scratch_path(spark, label), buckets=4)


@query(f"""WITH {CHUNKS}, {chunks_cte(128, "finer")}
SELECT chunk_id, source_id, token_count, md5(text) AS text_md5 FROM chunks
WHERE source_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL
SELECT chunk_id, source_id, token_count, md5(text) FROM finer
WHERE source_id IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def row_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Write all chunks, then replace those of the low-quality sources by finer
    ones; sources without new rows keep theirs."""
    table = new_table(spark, "row_replace")
    docs = tables.documents(spark, sf)
    table.replace_rows(fixed_size_chunks(docs))
    low = tables.table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("source_id"))
    table.replace_rows(fixed_size_chunks(docs.join(low, "source_id", "left_semi"), budget=128))
    return table.read().select(
        "chunk_id", "source_id", "token_count", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


@query(f"""WITH {CHUNKS},
u AS (SELECT c.chunk_id, CASE WHEN l.quality = 1 THEN least(1.0, c.token_count / 512.0) END AS s
      FROM chunks c JOIN labels l ON l.doc_id = c.source_id)
SELECT c.chunk_id, c.token_count, u.chunk_id IS NULL AS untouched,
       round(CASE WHEN u.chunk_id IS NOT NULL THEN u.s ELSE 0.25 END, 6) AS attr_quality_score,
       CASE WHEN u.chunk_id IS NOT NULL THEN 'length_heuristic' ELSE 'first' END AS attr_quality_provider
FROM chunks c LEFT JOIN u ON u.chunk_id = c.chunk_id""")
def column_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Merge scores into stored rows; an incoming NULL overwrites."""
    table = new_table(spark, "column_merge")
    table.replace_rows(
        tables.chunks(spark, sf)
        .withColumn("attr_quality_score", F.lit(0.25))
        .withColumn("attr_quality_provider", F.lit("first"))
        .withColumn("attr_lang_code", F.lit("kept"))
    )
    labels = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("source_id"), "quality")
    scores = tag_quality_by_length(table.read()).join(labels, "source_id")
    table.merge(
        scores.select(
            "chunk_id",
            "source_id",
            F.when(F.col("quality") == 1, F.col("attr_quality_score")).alias("attr_quality_score"),
            "attr_quality_provider",
        )
    )
    return table.read().where("attr_lang_code = 'kept'").select(
        "chunk_id",
        "token_count",
        (F.col("attr_quality_provider") == "first").alias("untouched"),
        F.round(F.col("attr_quality_score").cast("double"), 6).alias("attr_quality_score"),
        "attr_quality_provider",
    )


@query(f"""WITH {CHUNKS}, u AS (SELECT doc_id || '_0' AS chunk_id, toxic FROM labels)
SELECT c.chunk_id, c.token_count, CAST(u.toxic AS VARCHAR) AS attr_toxic
FROM chunks c LEFT JOIN u ON u.chunk_id = c.chunk_id""")
def column_add(spark: SparkSession, sf: str) -> DataFrame:
    """Merging a column the table does not have yet adds it."""
    updates = tables.table(spark, sf, "labels").select(
        F.concat("doc_id", F.lit("_0")).alias("chunk_id"), F.col("toxic").alias("attr_toxic")
    )
    merged = merge_columns(tables.chunks(spark, sf), updates)
    return merged.select("chunk_id", "token_count", F.col("attr_toxic").cast("string"))


@query(f"""WITH {CHUNKS}
SELECT 'chunks' AS producer_asset, count(*) AS rows, CAST(sum(token_count) AS BIGINT) AS tokens
FROM chunks
UNION ALL
SELECT 'chunks__fine', count(*), CAST(sum(token_count) AS BIGINT) FROM ({chunks_cte(128, "f")[5:]})""")
def producers_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two producers share one table; each replaces only its own rows."""
    table = new_table(spark, "producers")
    docs = tables.documents(spark, sf)
    table.replace_rows(fixed_size_chunks(docs))
    table.replace_rows(fixed_size_chunks(docs, budget=128, producer="chunks__fine"))
    return (
        table.read()
        .groupBy("producer_asset")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("token_count").alias("tokens"))
    )


@query(f"""WITH {CHUNKS}
SELECT chunk_id, token_count FROM chunks WHERE source_id IN (SELECT doc_id FROM labels)""")
def backfill_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk the requested sources twice: the second run changes nothing."""
    table = new_table(spark, "backfill")
    asked = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    for _ in range(2):
        backfill(tables.documents(spark, sf), asked, table)
    return table.read().select("chunk_id", "token_count")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) + 99 AS id
  FROM documents)
SELECT id, lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.pdf' AS original_name, sha256(text) AS sha256,
       CAST(octet_length(encode(text)) AS BIGINT) AS size, 'application/pdf' AS mime_type,
       's3://sources/' || id || '/original.pdf' AS storage_uri, 'src_' || id AS partition_key
FROM n""")
def source_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows of new files: name, hash, size, and consecutive ids."""
    found = tables.documents(spark, sf).select(
        F.concat(F.lit("/inbox/"), F.lpad(F.col("source_id").cast("string"), 12, "0"), F.lit(".pdf")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return files.source_rows(found, 100).drop("kind")


@query("""WITH p AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE n_chars % 7 + 1 END AS n
                   FROM documents)
SELECT doc_id AS source_id, CAST(n AS INTEGER) AS pages,
       '{"name":"source_' || doc_id || '","pages":{' ||
       array_to_string(list_transform(range(1, n + 1), lambda i: '"' || i || '":{"page_no":' || i ||
         ',"size":{"width":612.0,"height":792.0}}'), ',') || '}}' AS doc_json
FROM p""")
def placeholder_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Page counts out of PDF bytes, and the documents made from them."""
    counted = tables.table(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"),
        files.page_count(
            F.encode(
                F.concat(
                    F.lit("%PDF-1.4 "),
                    "text",
                    F.expr("CASE WHEN n_chars % 3 = 0 THEN ' /Type /Pages' ELSE"
                           " concat(' /Type /Pages /Count  ', n_chars % 7 + 1, ' /Count 99') END"),
                ),
                "UTF-8",
            )
        ).alias("pages"),
    )
    return counted.withColumn(
        "doc_json", files.placeholder_document(F.col("source_id"), F.col("pages"))
    )


@query("""SELECT doc_id AS source_id, 'mineru' AS extractor_name,
       CASE WHEN doc_id % 50 = 0 THEN 'unparsable body' END AS error,
       CASE WHEN doc_id % 50 > 0 THEN '# ' || text || chr(10) END AS markdown, 'run-1' AS run FROM documents""")
def document_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write bodies and manifests, read them by the engine's reader and render them."""
    docs = tables.documents(spark, sf).select(
        "source_id",
        F.lit("key").alias("source_key"),
        F.lit("").alias("sha256"),
        F.when(F.col("source_id") % 50 == 0, F.lit("{")).otherwise(F.to_json(F.struct(F.col("text").alias("name")))).alias("doc_json"),
    )
    root = scratch_path(spark, "documents")
    document_store.write_documents(docs, root, "run-1")
    rendered = render_markdown(document_store.read_written(spark, root))
    return rendered.select("source_id", "extractor_name", "error", "markdown", "run")


@query("""SELECT doc_id AS source_id, 1 AS schema_version, 'mineru' AS extractor_name,
       'sources/' || doc_id || '/original.pdf' AS source_key, sha256(text) AS sha256,
       sha256('{}') AS config_hash, 'run-1' AS run_id
FROM documents""")
def document_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Write bodies and manifests, then read the manifests back."""
    docs = tables.documents(spark, sf).select(
        "source_id",
        F.concat(F.lit("sources/"), "source_id", F.lit("/original.pdf")).alias("source_key"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.to_json(F.struct(F.col("text").alias("name"))).alias("doc_json"),
    )
    root = scratch_path(spark, "documents")
    document_store.write_documents(docs, root, "run-1")
    field = lambda path: F.get_json_object("manifest", path)
    return spark.read.parquet(f"{root}/manifests").select(
        "source_id",
        field("$.schema_version").cast("int").alias("schema_version"),
        field("$.extractor_name").alias("extractor_name"),
        field("$.source_refs[0].key").alias("source_key"),
        field("$.source_refs[0].sha256").alias("sha256"),
        field("$.config_hash").alias("config_hash"),
        field("$.dagster_run_id").alias("run_id"),
    )


@query("""SELECT l.doc_id AS source_id,
       CASE WHEN l.doc_id % 4 = 0 THEN 'missing body'
            WHEN l.doc_id % 4 = 1 THEN 'unparsable body' END AS error
FROM labels l""")
def document_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Requested bodies: some are missing, some do not parse."""
    bodies = tables.table(spark, sf, "documents").where("doc_id % 4 <> 0").select(
        F.col("doc_id").alias("source_id"),
        F.when(F.expr("doc_id % 4 = 1"), F.concat(F.lit("{"), "text"))
        .otherwise(F.to_json(F.struct("text")))
        .alias("doc_json"),
    )
    asked = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("source_id"))
    return document_store.require_bodies(asked, bodies).select("source_id", "error")
