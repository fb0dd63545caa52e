"""Engine tables derived from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.session import tune
from chunkloom.sources import hadoop

# Sources of this collection number count as belonging to no collection.
NO_COLLECTION = 19


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a file stream, be it one file or a folder of files."""
    path, reader = f"{sf}/{name}.parquet", spark.readStream.schema(table(spark, sf, name).schema)
    # A stream lists a folder: for a single file the one it lies in.
    if hadoop.is_file(spark, path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return reader.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has
    cores (one small file); larger inputs are left as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """documents(source_id, source_collection_id, text, *extra)."""
    df = table(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"),
        F.expr("cast(substr(source, 4) as bigint)").alias("source_collection_id"),
        "text",
        *extra,
    )
    return spread(df, "source_id")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("original_name"),
        F.expr(f"nullif(cast(substr(source, 4) as bigint), {NO_COLLECTION})").alias(
            "collection_id"
        ),
        F.col("n_chars").alias("size"),
        "lang",
    )


def collections(spark: SparkSession, sf: str) -> DataFrame:
    """One row per collection; owner by number."""
    number = F.expr("cast(substr(source, 4) as bigint)")
    return (
        table(spark, sf, "documents")
        .select(number.alias("id"))
        .distinct()
        .select("id", (F.col("id") % 3).alias("owner_id"))
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_size_chunks(documents(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their quality label, NULL where there is none."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


def recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes from customers, one per customer."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("definition"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, c_custkey % 97)").alias(
            "created_at"
        ),
    )


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Data sets from orders: recipe = customer, status by order status."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("recipe_id"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'pending' END").alias(
            "status"
        ),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN 100L END").alias("sample_count"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN 5000L END").alias("size_bytes"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN cast(o_orderdate AS timestamp) END").alias(
            "materialized_at"
        ),
    )


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Document variants from line items: source = order, extractor = flag."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("source_id"),
        F.col("l_returnflag").alias("extractor_name"),
        F.col("l_linestatus").alias("config_hash"),
        (F.col("l_linenumber") == 1).alias("is_canonical"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Run and asset events; the run is the user, asset events carry keys that
    are malformed or missing for some."""
    raw = table(spark, sf, "events")
    return as_run_events(raw)


def as_run_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("run_id"),
        F.expr(
            "CASE event_type WHEN 'signup' THEN 'RUN_START' WHEN 'purchase' THEN 'RUN_SUCCESS'"
            " WHEN 'error' THEN 'RUN_FAILURE' ELSE 'ASSET_MATERIALIZATION' END"
        ).alias("event_type"),
        F.expr(
            "CASE event_type WHEN 'click' THEN 'chunks' WHEN 'view' THEN 'extract_mineru' END"
        ).alias("asset_key"),
        F.expr(
            "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN 'src_x'"
            " ELSE concat('src_', event_id) END"
        ).alias("partition_key"),
        F.expr(
            "CASE WHEN event_id % 5 = 0 THEN '{}'"
            " ELSE concat('{\"chunk_count\": ', get_json_object(props, '$.k'), '}') END"
        ).alias("metadata"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Known runs: users whose number is no multiple of 10; every seventh has
    no owner."""
    return (
        table(spark, sf, "events")
        .select(F.col("user_id").alias("run_id"))
        .distinct()
        .where("run_id % 10 <> 0")
        .select(
            "run_id",
            F.lit("pending").alias("status"),
            F.lit(None).cast("timestamp").alias("started_at"),
            F.lit(None).cast("timestamp").alias("ended_at"),
            F.expr("CASE WHEN run_id % 7 <> 0 THEN run_id % 4 END").alias("triggered_by"),
        )
    )


def derived_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of derived chunks over the documents, 40 documents to a chain.

    By number of the chain: sound ones, cycles, chains whose first parent is
    missing, and chains whose root has no source.
    """
    d, chain = "doc_id", "(doc_id DIV 40) % 5"
    return table(spark, sf, "documents").select(
        F.expr(f"concat('n', {d})").alias("chunk_id"),
        F.expr(f"CASE WHEN {chain} = 3 AND {d} % 40 = 0 THEN NULL ELSE {d} END").alias("source_id"),
        F.expr(
            f"CASE WHEN {d} % 40 > 0 THEN concat('n', {d} - 1)"
            f" WHEN {chain} = 1 THEN concat('n', {d} + 10 + ({d} DIV 200) % 25)"
            f" WHEN {chain} = 2 THEN concat('gone', {d}) END"
        ).alias("augmented_from"),
    )
