"""Tagger queries: quality, language, near duplicates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.templates import render
from chunkloom.operators import language, minhash, quality
from chunkloom.operators.assets import run_tagger
from chunkloom.operators.embedding import tag_embeddings
from chunkloom.plans import explore, selection
from chunkloom.session import scratch_path
from chunkloom.sources.chunk_table import ChunkTable
from workload import tables
from workload.models import LengthJudge
from workload.registry import CHUNKS, query


def _score(df: DataFrame, column: str) -> DataFrame:
    """Float scores as rounded doubles, so that both engines print them alike."""
    return df.withColumn(column, F.round(F.col(column).cast("double"), 5))


@query(f"""WITH {CHUNKS}
SELECT chunk_id, source_id, round(least(1.0, token_count / 512.0), 5) AS attr_quality_score,
       'length_heuristic' AS attr_quality_provider FROM chunks""")
def quality_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return _score(quality.tag_quality_by_length(tables.chunks(spark, sf)), "attr_quality_score")


PROMPT_CHARS = len(quality.SCORING_PROMPT) - len("{chunk_text}")


@query(f"""WITH {CHUNKS}, p AS (SELECT *, {PROMPT_CHARS} + length(text) AS n FROM chunks)
SELECT chunk_id, source_id,
       CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN 0.0 ELSE least(1.0, (n % 15) / 10.0) END
         AS attr_quality_score,
       CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN 'error' ELSE 'judge' END AS attr_quality_provider
FROM p""")
def quality_model(spark: SparkSession, sf: str) -> DataFrame:
    return _score(quality.tag_quality(tables.chunks(spark, sf), LengthJudge), "attr_quality_score")


@query(f"""WITH {CHUNKS}
SELECT chunk_id, md5('Rate the quality of the following text chunk on a scale from 0.0 to 1.0,
where 1.0 is high-quality, coherent, informative text and 0.0 is garbled,
empty, or meaningless content.

Text:
' || text || '

Respond with ONLY a single decimal number between 0.0 and 1.0. No explanation.') AS prompt_md5
FROM chunks""")
def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    prompt = render(quality.SCORING_PROMPT, {"chunk_text": F.col("text")})
    return tables.chunks(spark, sf).select("chunk_id", F.md5(prompt.cast("binary")).alias("prompt_md5"))


def _stop_word_sql() -> str:
    hits = ", ".join(
        f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stops)}))) AS n_{code}"
        for code, stops in sorted(language.STOP_WORDS.items())
    )
    best = "greatest(n_de, n_en, n_es, n_fr)"
    total = "(n_de + n_en + n_es + n_fr)"
    return f"""WITH {CHUNKS},
h AS (SELECT chunk_id, source_id, {hits}
      FROM (SELECT *, regexp_split_to_array(lower(text), '\\s+') AS w FROM chunks))
SELECT chunk_id, source_id,
       CASE WHEN {total} = 0 THEN 'und' WHEN n_de = {best} THEN 'de' WHEN n_en = {best} THEN 'en'
            WHEN n_es = {best} THEN 'es' ELSE 'fr' END AS attr_lang_code,
       CASE WHEN {total} = 0 THEN 0.0 ELSE round({best} / {total}, 5) END AS attr_lang_confidence
FROM h"""


@query(_stop_word_sql())
def lang_stopword(spark: SparkSession, sf: str) -> DataFrame:
    tagged = language.tag_language_by_stop_words(tables.chunks(spark, sf))
    return _score(tagged, "attr_lang_confidence")


@query(_stop_word_sql())
def stored_language(spark: SparkSession, sf: str) -> DataFrame:
    """Tag a stored chunk table, then read the tags back."""
    table = ChunkTable(spark, scratch_path(spark, "stored_language"), buckets=16)
    table.replace_rows(tables.chunks(spark, sf))
    run_tagger(table, "attr_lang")
    tagged = table.read().select("chunk_id", "source_id", "attr_lang_code", "attr_lang_confidence")
    return _score(tagged, "attr_lang_confidence")


@query(f"""WITH {CHUNKS}
SELECT source_collection_id, count(*) AS count, round(avg(CAST(token_count / 512.0 AS FLOAT)), 5) AS mean_attr_quality_score
FROM chunks WHERE token_count > 100 GROUP BY 1""")
def stored_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Score a stored chunk table, then explore it with a predicate."""
    table = ChunkTable(spark, scratch_path(spark, "stored_quality"), buckets=16)
    table.replace_rows(tables.chunks(spark, sf))
    run_tagger(table, "attr_quality_length")
    out = explore.aggregate(
        table.read(), "source_collection_id", ["count", "mean:attr_quality_score"], "token_count > 100"
    )
    return out.withColumn("mean_attr_quality_score", F.round("mean_attr_quality_score", 5))


def _bayes_sql() -> str:
    m, b = language.NgramModel.MULTIPLIER, language.NgramModel.BUCKETS

    def grams(source: str, keep: str) -> str:
        return f"""SELECT {keep}, ((u[i] * {m} + u[i + 1]) * {m} + u[i + 2]) % {b} AS bucket
          FROM (SELECT *, unnest(range(1, len(u) - 1)) AS i
                FROM (SELECT {keep}, list_transform(regexp_extract_all(lower(text), '(?s).'),
                             lambda c: CAST(unicode(c) AS BIGINT)) AS u FROM {source}))"""

    return f"""WITH {CHUNKS},
train AS (SELECT lang, bucket, count(*) AS n FROM ({grams("documents", "lang")}) GROUP BY ALL),
total AS (SELECT lang, sum(n) + {b} AS t FROM train GROUP BY lang),
model AS (SELECT t.lang, r.bucket, ln((coalesce(x.n, 0) + 1) / t.t) AS ll
          FROM total t CROSS JOIN range({b}) r(bucket)
          LEFT JOIN train x ON x.lang = t.lang AND x.bucket = r.bucket),
seen AS (SELECT chunk_id, source_id, bucket, count(*) AS n
         FROM ({grams("chunks", "chunk_id, source_id")}) GROUP BY ALL),
score AS (SELECT s.chunk_id, s.source_id, m.lang, sum(s.n * m.ll) AS s
          FROM seen s JOIN model m ON m.bucket = s.bucket GROUP BY ALL),
best AS (SELECT chunk_id, source_id, arg_max(lang, s) AS code, max(s) AS top
         FROM score GROUP BY chunk_id, source_id),
sure AS (SELECT b.chunk_id, b.source_id, b.code, 1 / sum(exp(s.s - b.top)) AS p
         FROM best b JOIN score s ON s.chunk_id = b.chunk_id GROUP BY ALL)
SELECT c.chunk_id, c.source_id, coalesce(code, 'und') AS attr_lang_code,
       coalesce(round(p, 5), 0.0) AS attr_lang_confidence
FROM chunks c LEFT JOIN sure ON sure.chunk_id = c.chunk_id"""


@query(_bayes_sql())
def lang_bayes(spark: SparkSession, sf: str) -> DataFrame:
    model = language.NgramModel.train(tables.documents(spark, sf, "lang"))
    return _score(
        language.tag_language(tables.chunks(spark, sf), lambda: model), "attr_lang_confidence"
    )


@functools.cache
def _signature_cte() -> str:
    mult, off = minhash.permutations()
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(mult, off)))
    return f"""{CHUNKS},
perms AS (SELECT i, CAST(a AS HUGEINT) AS a, CAST(b AS HUGEINT) AS b FROM (VALUES {rows}) p(i, a, b)),
lists AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w
          FROM chunks),
grams AS (SELECT DISTINCT chunk_id, sha1(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS h
          FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM lists)),
hashes AS (SELECT chunk_id, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2)
                                 || substr(h, 1, 2) AS HUGEINT) AS h FROM grams),
minima AS (SELECT chunk_id, i,
                  min(CAST((((a * h) % 18446744073709551616 + b) % 18446744073709551616)
                           % 2305843009213693951 % 4294967296 AS BIGINT)) AS v
           FROM hashes CROSS JOIN perms GROUP BY chunk_id, i),
sigs AS (SELECT c.chunk_id, c.source_id, c.source_collection_id, p.i, coalesce(m.v, 4294967295) AS v
         FROM chunks c CROSS JOIN perms p
         LEFT JOIN minima m ON m.chunk_id = c.chunk_id AND m.i = p.i)"""


@query(f"""WITH {_signature_cte()}
SELECT chunk_id, string_agg(v, ',' ORDER BY i) AS signature FROM sigs GROUP BY chunk_id""")
def minhash_signature(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.signatures(tables.chunks(spark, sf)).select(
        "chunk_id", F.array_join("attr_minhash_signature", ",").alias("signature")
    )


def _clusters_sql(scope: str) -> str:
    return f"""WITH RECURSIVE {_signature_cte()},
bands AS (SELECT chunk_id, {scope} AS scope, i // 16 AS band, string_agg(v, ',' ORDER BY i) AS digest
          FROM sigs GROUP BY ALL),
hubs AS (SELECT scope, band, digest, min(chunk_id) AS hub FROM bands GROUP BY ALL HAVING count(*) > 1),
links AS (SELECT DISTINCT b.chunk_id AS x, h.hub AS y FROM bands b
          JOIN hubs h ON h.scope = b.scope AND h.band = b.band AND h.digest = b.digest
          WHERE b.chunk_id <> h.hub),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT chunk_id AS x, chunk_id AS y FROM chunks
          UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
heads AS (SELECT x AS chunk_id, min(y) AS head FROM reach GROUP BY x)
SELECT c.chunk_id, c.{scope},
       dense_rank() OVER (PARTITION BY c.{scope} ORDER BY h.head) - 1 AS attr_minhash_cluster_id,
       c.chunk_id = h.head AS attr_minhash_is_head
FROM chunks c JOIN heads h ON h.chunk_id = c.chunk_id"""


@query(_clusters_sql("source_id"))
def minhash_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.tag_near_duplicates(tables.chunks(spark, sf)).drop("attr_minhash_signature")


@query(_clusters_sql("source_collection_id"))
def minhash_clusters_collection(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a collection as the scope: larger groups, more copies."""
    return minhash.tag_near_duplicates(
        tables.chunks(spark, sf), "source_collection_id"
    ).drop("attr_minhash_signature")


@query(f"SELECT chunk_id FROM ({_clusters_sql('source_collection_id')}) WHERE attr_minhash_is_head")
def dedup_heads(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk of each near-duplicate cluster."""
    tagged = minhash.tag_near_duplicates(tables.chunks(spark, sf), "source_collection_id")
    return selection.heads(tagged).select("chunk_id")


@query(f"""WITH {CHUNKS},
w AS (SELECT chunk_id, regexp_extract_all(lower(text), '\\S+') AS w FROM chunks),
f AS (SELECT chunk_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
c AS (SELECT chunk_id, md5(f) AS d, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT d, count(*) AS texts FROM c GROUP BY d),
p AS (SELECT chunk_id, CAST('0x' || substr(d, 1, 12) AS BIGINT) % 1024 AS at1,
             CASE WHEN CAST('0x' || substr(d, 13, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END
             * (1 + ln(n)) * (1 + ln(((SELECT count(*) FROM chunks) + 1) / (texts + 1))) AS v FROM c JOIN t USING (d)),
s AS (SELECT chunk_id, at1, sum(v) AS v FROM p GROUP BY ALL),
l AS (SELECT chunk_id, sqrt(sum(v * v)) AS l FROM s GROUP BY chunk_id),
e AS (SELECT chunk_id, at1 AS i, CAST(v / l AS FLOAT) AS x FROM s JOIN l USING (chunk_id))
SELECT chunk_id, CAST(count(*) AS INTEGER) AS places, CAST(sum(CAST(round(CAST(x AS DOUBLE) * 100000) AS BIGINT) * (1 + i)) AS BIGINT) AS weighted
FROM e WHERE CAST(round(CAST(x AS DOUBLE) * 100000) AS BIGINT) <> 0 GROUP BY chunk_id""")
def embed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Places that are not zero after five decimals, and their sum weighted by place."""
    vectors = tag_embeddings(tables.chunks(spark, sf))
    whole = F.transform("attr_embed_vector", lambda x: F.round(x.cast("double") * 100000).cast("bigint"))
    sums = F.aggregate(F.transform(whole, lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return vectors.select("chunk_id", F.size(F.filter(whole, lambda x: x != 0)).alias("places"), sums.alias("weighted"))
