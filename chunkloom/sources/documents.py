"""Document bodies: reading them, and writing them with a lineage manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.schema import EXTRACTOR_NAME, EXTRACTOR_VERSION, config_hash
from chunkloom.sources import hadoop

# Fixed value: one body per source, below the source's id.
BODY_GLOB = "*/extract_*/doc.docling.json"
_BODY_PATH = r"(\d+)/extract_([^/]+)/doc\.docling\.json$"


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """Add ``error`` to (source_id, doc_json): NULL when the JSON parses."""
    tree = F.try_parse_json("doc_json")
    return bodies.withColumn(
        "error",
        F.when(F.col("doc_json").isNull(), "missing body").when(tree.isNull(), "unparsable body"),
    )


def read_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, extractor_name, doc_json, error) of all stored bodies."""
    path = F.col("_metadata.file_path")
    raw = spark.read.text(f"{root}/{BODY_GLOB}", wholetext=True).select(
        F.regexp_extract(path, _BODY_PATH, 1).cast("bigint").alias("source_id"),
        F.regexp_extract(path, _BODY_PATH, 2).alias("extractor_name"),
        F.col("value").alias("doc_json"),
    )
    return parse_bodies(raw)


def read_written(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, extractor_name, doc_json, error, run) of what ``write_documents`` left.

    A body counts once its manifest is there, so a run that failed on the way is not
    seen; a source written by several runs has a row for each.
    """
    if not hadoop.exists(spark, f"{root}/manifests"):
        return spark.createDataFrame(
            [], "source_id bigint, extractor_name string, doc_json string, error string, run string"
        )
    marks = spark.read.parquet(f"{root}/manifests").select(
        F.col("run").cast("string").alias("run"),
        "source_id",
        F.get_json_object("manifest", "$.extractor_name").alias("extractor_name"),
    )
    bodies = spark.read.parquet(f"{root}/bodies").select(F.col("run").cast("string").alias("run"), "source_id", "doc_json")
    found = bodies.join(marks, ["run", "source_id"])
    return parse_bodies(found.select("source_id", "extractor_name", "doc_json", "run")).select(
        "source_id", "extractor_name", "doc_json", "error", "run"
    )


def require_bodies(requested: DataFrame, bodies: DataFrame) -> DataFrame:
    """Every requested source with its body, or with the reason it has none."""
    return parse_bodies(
        requested.select("source_id").join(
            bodies.select("source_id", "doc_json"), "source_id", "left"
        )
    )


def manifest_json(
    bucket: Column, key: Column, sha256: Column, run_id: Column, created_at: Column,
    config: dict | None = None, extractor: str = EXTRACTOR_NAME,
    version: str = EXTRACTOR_VERSION, images: Column | None = None,
) -> Column:
    """The manifest of one extraction: inputs, extractor identity, run and the
    file names of its images."""
    none = F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"),
            F.lit(extractor).alias("extractor_name"),
            F.lit(version).alias("extractor_version"),
            F.lit(config_hash(config or {})).alias("config_hash"),
            run_id.alias("dagster_run_id"),
            created_at.alias("created_at"),
            F.array(
                F.struct(bucket.alias("bucket"), key.alias("key"), sha256.alias("sha256"))
            ).alias("source_refs"),
            (none if images is None else F.coalesce(images, none)).alias("images"),
        )
    )


def write_documents(
    documents: DataFrame,
    root: str,
    run_id: str,
    images: DataFrame | None = None,
    bucket: str = "sources",
) -> None:
    """Write bodies, then images, then the manifests as the commit marker.

    ``documents(source_id, source_key, sha256, doc_json)`` and
    ``images(source_id, filename, data)``.  Each is a table below ``root``, one
    folder per run; a run is complete when its manifest folder has ``_SUCCESS``.
    A failed run removes what it wrote.
    """
    spark = documents.sparkSession
    parts = {p: f"{root}/{p}/run={run_id}" for p in ("bodies", "images", "manifests")}
    try:
        documents.write.mode("overwrite").parquet(parts["bodies"])
        written = spark.read.parquet(parts["bodies"])
        names = None
        if images is not None:
            images.write.mode("overwrite").parquet(parts["images"])
            listed = (
                spark.read.parquet(parts["images"])
                .groupBy("source_id")
                .agg(F.sort_array(F.collect_list("filename")).alias("_images"))
            )
            written, names = written.join(listed, "source_id", "left"), F.col("_images")
        manifest = manifest_json(
            F.lit(bucket),
            F.col("source_key"),
            F.col("sha256"),
            F.lit(run_id),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
            images=names,
        )
        written.select("source_id", manifest.alias("manifest")).write.mode("overwrite").parquet(
            parts["manifests"]
        )
    except Exception:
        for part in parts.values():
            hadoop.delete(spark, part)
        raise


def complete_runs(spark: SparkSession, root: str, run_ids: list[str]) -> list[str]:
    return [r for r in run_ids if hadoop.exists(spark, f"{root}/manifests/run={r}/_SUCCESS")]
