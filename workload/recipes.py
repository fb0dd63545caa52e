"""Recipe queries: splits, synthesis, previews, published data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.synthesis import split_of
from chunkloom.plans import recipes
from chunkloom.session import scratch_path
from chunkloom.sources.dataset_sink import read_splits
from workload import tables
from workload.models import QuoteModel
from workload.registry import CHUNKS, query


def _bucket_sql(value: str) -> str:
    """md5 of a value as one integer, modulo 100."""
    return (
        "list_reduce(list_prepend(0, list_transform(range(1, 33), lambda i:"
        f" strpos('0123456789abcdef', substr(md5({value}), i, 1)) - 1)), lambda a, b: (a * 16 + b) % 100)"
    )


@query(f"""WITH {CHUNKS}
SELECT chunk_id, CASE WHEN {_bucket_sql("chunk_id")} < 28 THEN 'validation' ELSE 'train' END AS split
FROM chunks""")
def split_md5(spark: SparkSession, sf: str) -> DataFrame:
    """A share of 0.29 means 28 per cent: the product is rounded down."""
    return tables.chunks(spark, sf).select("chunk_id", split_of(F.col("chunk_id"), 0.29).alias("split"))


RECIPE = {
    "filter": {"where": "token_count > 50 AND source_collection_id <> 4"},
    "schema": {"template": "sft_synthesis_qa", "config": {"prompt_template": "{{q}} {chunk_text}"}},
    "output": {"splits": {"validation": 0.2}},
}

_ANSWERED = f"""{CHUNKS},
asked AS (SELECT chunk_id, source_id, '{{q}} ' || text AS prompt FROM chunks
          WHERE token_count > 50 AND source_collection_id <> 4),
answered AS (SELECT chunk_id, 'Quote: ' || substr(prompt, 1, 40) AS instruction,
                    CAST(length(prompt) AS VARCHAR) AS output
             FROM asked
             WHERE length(prompt) % 7 <> 0 AND length(prompt) % 11 <> 0 AND length(prompt) % 13 <> 0),
split AS (SELECT *, CASE WHEN {_bucket_sql("chunk_id")} < 20 THEN 'validation' ELSE 'train' END AS split
          FROM answered)"""


@query(f"WITH {_ANSWERED} SELECT split, instruction, output, chunk_id FROM split")
def sft_materialize(spark: SparkSession, sf: str) -> DataFrame:
    return recipes.dataset_rows(tables.chunks(spark, sf), RECIPE, QuoteModel)


@query(f"WITH {_ANSWERED} SELECT split, instruction, output, chunk_id FROM split")
def dataset_publish(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows, written as a data set and read back from its files."""
    done = recipes.materialize_dataset(
        tables.chunks(spark, sf), RECIPE, scratch_path(spark, "datasets"), 7, "v1", QuoteModel
    )
    return read_splits(spark, done["path"]).select("split", "instruction", "output", "chunk_id")


@query(f"""WITH {_ANSWERED}
SELECT s.split, count(x.chunk_id) AS num_examples, 0 AS missing_bytes
FROM (VALUES ('train'), ('validation')) s(split) LEFT JOIN split x ON x.split = s.split
GROUP BY s.split""")
def dataset_infos(spark: SparkSession, sf: str) -> DataFrame:
    """Example counts as the published info sidecar states them."""
    done = recipes.materialize_dataset(
        tables.chunks(spark, sf), RECIPE, scratch_path(spark, "datasets"), 8, "v1", QuoteModel
    )
    split = "struct<num_examples:bigint,num_bytes:bigint>"
    info = spark.read.schema(
        f"default struct<splits:map<string,{split}>>"
    ).option("multiLine", "true").json(f"{done['path']}/dataset_infos.json")
    return info.select(F.explode("default.splits").alias("split", "i")).select(
        "split",
        "i.num_examples",
        F.when(F.col("i.num_bytes") > 0, 0).otherwise(1).alias("missing_bytes"),
    )


@query(f"""WITH {CHUNKS},
sample AS (SELECT * FROM chunks WHERE token_count >= 100 ORDER BY source_id, chunk_id LIMIT 5),
asked AS (SELECT chunk_id, text, token_count || ' tokens: ' || text AS prompt FROM sample)
SELECT chunk_id,
       CASE WHEN length(prompt) % 7 = 0 OR length(prompt) % 11 = 0 THEN substr(text, 1, 200)
            ELSE 'Quote: ' || substr(prompt, 1, 40) END AS instruction,
       CASE WHEN length(prompt) % 7 = 0 THEN 'no json here' WHEN length(prompt) % 11 = 0 THEN '0.5'
            ELSE CAST(length(prompt) AS VARCHAR) END AS output
FROM asked""")
def recipe_preview(spark: SparkSession, sf: str) -> DataFrame:
    definition = {
        "filter": {"where": "token_count >= 100"},
        "schema": {
            "template": "sft_synthesis_qa",
            "config": {"prompt_template": "{token_count} tokens: {text}", "fallback_on_failure": True},
        },
    }
    return recipes.preview(tables.chunks(spark, sf), definition, 5, lambda: QuoteModel(steady=True))


@query("""WITH k AS (SELECT o_orderkey AS id, CASE o_orderkey % 4
    WHEN 0 THEN 'ds_' || o_custkey || '_v' || (o_orderkey % 9)
    WHEN 1 THEN 'ds_' || o_custkey || '_v' WHEN 2 THEN 'src_' || o_custkey ELSE 'src_x' END AS key
  FROM orders)
SELECT id, key, nullif(regexp_extract(key, '^ds_(\\d+)_(v\\d+)$', 1), '') AS recipe_id,
       nullif(regexp_extract(key, '^ds_(\\d+)_(v\\d+)$', 2), '') AS version_tag,
       nullif(regexp_extract(key, '^src_(\\d+)$', 1), '') AS source_id
FROM k""")
def partition_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN concat('ds_', o_custkey, '_v', o_orderkey % 9)"
        " WHEN 1 THEN concat('ds_', o_custkey, '_v') WHEN 2 THEN concat('src_', o_custkey)"
        " ELSE 'src_x' END"
    )
    keyed = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), key.alias("key"))
    recipe_id, tag = recipes.dataset_key_columns(F.col("key"))
    return keyed.select(
        "id",
        "key",
        recipe_id.cast("string").alias("recipe_id"),
        tag.alias("version_tag"),
        recipes.source_key_column(F.col("key")).cast("string").alias("source_id"),
    )
