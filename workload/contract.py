"""Runs again over stored chunks: what the ledger leaves to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.operators.contract import Ledger, Operator, run_operator
from chunkloom.session import scratch_path
from chunkloom.sources.chunk_table import ChunkTable
from workload import tables
from workload.registry import CHUNKS, query


def _shout(config: dict) -> dict[str, Column]:
    return {"attr_capitals": F.length(F.regexp_replace("text", "[^A-Z]", "")) > config["most"]}


CAPITALS = Operator(
    "capitals", "1", "tagger", {"most": {"type": "integer", "minimum": 0, "default": 20}}, T.StructType().add("chunk_id", "string").add("attr_capitals", "boolean"), columns=_shout
)


@query(f"""WITH {CHUNKS},
n AS (SELECT count(*) AS a, count(*) FILTER (doc_id % 2 = 0) AS e FROM documents)
SELECT 'first' AS run, e AS sources FROM n UNION ALL SELECT 'all', a - e FROM n UNION ALL SELECT 'again', 0 UNION ALL SELECT 'other', a FROM n
UNION ALL SELECT 'capitals', count(*) FROM chunks WHERE length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10""")
def operator_reruns(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that each run had to read: half, the other half, none, and all again for another setting, whose tags are counted."""
    table = ChunkTable(spark, scratch_path(spark, "operated"), buckets=4)
    table.replace_rows(tables.chunks(spark, sf))
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    every = tables.sources(spark, sf).select("id")
    done = [
        ("first", run_operator(CAPITALS, table, ledger, {}, every.where("id % 2 = 0"))),
        ("all", run_operator(CAPITALS, table, ledger, {"most": 20}, every)),
        ("again", run_operator(CAPITALS, table, ledger, {}, every)),
        ("other", run_operator(CAPITALS, table, ledger, {"most": 10}, every)),
    ]
    tagged = table.read().agg(F.lit("capitals").alias("run"), F.count_if("attr_capitals").alias("sources"))
    return spark.createDataFrame(done, "run string, sources long").union(tagged)
