"""Data sets without a model: plain and joined texts, chat rows, multiple choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import materialisers
from workload import tables
from workload.registry import CHUNKS, query

LIMIT = 1500


def _concat_sql(by: str) -> str:
    return f"""WITH RECURSIVE {CHUNKS},
    o AS (SELECT {by} AS g, text, token_count AS t,
                 row_number() OVER (PARTITION BY {by} ORDER BY source_id, CAST(string_split(chunk_id, '_')[-1] AS BIGINT)) AS n FROM chunks),
    w AS (SELECT g, n, t AS total, 0 AS doc FROM o WHERE n = 1
          UNION ALL SELECT o.g, o.n, CASE WHEN total + t > {LIMIT} THEN t ELSE total + t END, doc + CASE WHEN total + t > {LIMIT} THEN 1 ELSE 0 END
          FROM w JOIN o ON o.g = w.g AND o.n = w.n + 1)
    SELECT g AS {by}, CAST(doc AS BIGINT) AS doc, count(*) AS n_chunks, CAST(sum(t) AS BIGINT) AS token_count,
           string_agg(text, '|' ORDER BY n) AS text FROM w JOIN o USING (g, n) GROUP BY g, doc"""


@query(_concat_sql("source_id"))
def cpt_concat(spark: SparkSession, sf: str) -> DataFrame:
    return materialisers.cpt_concat(tables.chunks(spark, sf), LIMIT, separator="|")


@query(_concat_sql("source_collection_id"))
def cpt_concat_collections(spark: SparkSession, sf: str) -> DataFrame:
    """The same over whole collections, which hold many chunks each."""
    return materialisers.cpt_concat(tables.chunks(spark, sf), LIMIT, separator="|", by="source_collection_id")


@query(f"WITH {CHUNKS} SELECT chunk_id, text AS content FROM chunks")
def cpt_plain(spark: SparkSession, sf: str) -> DataFrame:
    return materialisers.cpt_plain(tables.chunks(spark, sf), "content")


@query(f"""WITH {CHUNKS}
SELECT chunk_id, '[{{"role":"system","content":"Answer."}},{{"role":"user","content":"Say {{it}} of ' || source_id || '"}},{{"role":"assistant","content":'
       || to_json(text) || '}}]' AS messages FROM chunks""")
def sft_from_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return materialisers.sft_from_chunks(tables.chunks(spark, sf), "Say {{it}} of {source_id}", "Answer.")


@query("""WITH
q AS (SELECT doc_id AS id, lang AS g, w[1:5] AS question, array_to_string(w[-3:], ' ') AS answer
      FROM (SELECT doc_id, lang, regexp_extract_all(text, '\\S+') AS w FROM documents)),
a AS (SELECT g, answer, row_number() OVER (PARTITION BY g ORDER BY md5('42:' || answer), answer) AS n, count(*) OVER (PARTITION BY g) AS c
      FROM (SELECT DISTINCT g, answer FROM q)),
o AS (SELECT id, b.answer AS option, a.answer AS answer FROM q JOIN a USING (g, answer) JOIN a b ON b.g = a.g AND (b.n - a.n + a.c) % a.c <= 3)
SELECT id, array_to_string(any_value(question), ' ') AS question, string_agg(option, '|' ORDER BY md5('42:' || id || ':' || option), option) AS options,
       CAST(count(*) FILTER (md5('42:' || id || ':' || option) < md5('42:' || id || ':' || o.answer)) AS INTEGER) AS answer_at
FROM o JOIN q USING (id) GROUP BY id""")
def multiple_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The first words of a document ask for its last ones, among endings of documents in the same language."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    asked = tables.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.array_join(F.slice(words, 1, 5), " ").alias("question"),
        F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), " ").alias("answer"),
        F.col("lang").alias("group"),
    )
    made = materialisers.multiple_choice(asked, 3)
    return made.withColumn("options", F.array_join("options", "|"))
