"""The operators on the driver's tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import chat, decontam, embeddings, fim, langid, licenses, line_dedup, lm, merkle, packing, pu_quality, simhash, warc
from chunkloom.llm.common import fold
from chunkloom.session import scratch_path, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


@query()
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query(
    """
    WITH RECURSIVE
      v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
      reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
    SELECT r.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links,
           min(r.b) AS component_id, r.a = min(r.b) AS kept
    FROM reach r GROUP BY r.a
    """
)
def op8_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    f"""
    WITH
      d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
      i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
      iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s + 1, s + 10), ' ') AS k, least(10, len(w)) AS n
             FROM (SELECT *, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
      sizes AS (SELECT DISTINCT n FROM iw),
      dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS k
             FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
      hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (k, n)),
      pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
      its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
    """
)
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op10_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query()
def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
         f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
    SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest,
           CASE WHEN strlen(t) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN strlen(t) >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f
    """
)
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).select(
        F.col("id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers").cast("long").alias("refers_to"),
    )


def chat_sql() -> str:
    """Conversations, formatted_chars by counting control strings."""
    opened = " ".join(f"WHEN '{role}' THEN {len(c)}" for role, c in chat.OPEN.items())
    controls = " + ".join(f"2 * ((length(t) - length(replace(t, '{c}', ''))) // {len(c)})" for c in chat.CONTROLS)
    escapes = "length(t) - length(replace(t, chr(26), ''))"
    other = len("<|role|>") + len("<|text|>")
    return f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
           CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
           CAST(sum(CASE r {opened} ELSE {other} + length(r) END + 4 + length(t) + {escapes} + {controls}) AS BIGINT)
             AS formatted_chars
    FROM c GROUP BY conv_id
    """


@query(chat_sql())
def op1_chat(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_turns(turns.union(extra), path), path)


@query()
def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = fold(F.col("doc_id"), 3, 1)
    predict = langid.predictor(langid.learn(docs.where(~held_out)))
    answers = docs.select("doc_id", held_out.alias("held_out"), predict("text").alias("answer"))
    return answers.select("doc_id", "held_out", "answer.lang_pred", "answer.score")


@query()
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5, 0)
    scored = pu_quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "score", "predicted")


@query()
def op9_lm(spark: SparkSession, sf: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 10, 0)
    scored = lm.score_documents(table(spark, sf, "documents"), F.col("doc_id").isNotNull() & ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    step = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, k: {step})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


def merkle_sql() -> str:
    """Trees as lists of nodes, one row for each tree and level; proofs and folds level by level."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    up = "list_transform(range(0, (len(nodes) + 7) // 8), lambda r: sha256(array_to_string(nodes[r * 8 + 1 : r * 8 + 8], '')))"
    return f"""
    WITH RECURSIVE
      d AS (SELECT *, row_number() OVER () AS id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, {leaf(lower)} AS low FROM documents),
      l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos,
                   CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN low ELSE leaf END AS claimed FROM d),
      g AS (SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM l GROUP BY tree
            UNION ALL SELECT tree, level + 1, {up} FROM g WHERE len(nodes) > 1),
      s AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM g WHERE len(nodes) = 1),
      t AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM s
            UNION ALL SELECT level + 1, {up} FROM t WHERE len(nodes) > 1),
      root AS (SELECT nodes[1] AS root FROM t WHERE len(nodes) = 1),
      up AS (SELECT id, level, pos // CAST(pow(8, level) AS BIGINT) AS p, nodes FROM l JOIN g USING (tree) WHERE len(nodes) > 1
             UNION ALL SELECT id, 100 + level, s.pos // CAST(pow(8, level) AS BIGINT), nodes FROM l JOIN s USING (tree), t WHERE len(nodes) > 1),
      steps AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS step,
                       array_to_string(nodes[p - p % 8 + 1 : p], '') AS b, array_to_string(nodes[p + 2 : p - p % 8 + 8], '') AS a FROM up),
      fold AS (SELECT id, 0 AS step, claimed AS h FROM l
               UNION ALL SELECT f.id, f.step + 1, sha256(b || h || a) FROM fold f JOIN steps x ON x.id = f.id AND x.step = f.step + 1),
      ended AS (SELECT id, arg_max(h, step) AS h FROM fold GROUP BY id),
      proof AS (SELECT id, string_agg(b || a, '' ORDER BY step) AS p FROM steps GROUP BY id)
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, h AS folded_root, h = root AS verified
    FROM l JOIN s USING (tree) JOIN ended USING (id) LEFT JOIN proof USING (id), root
    """


@query(merkle_sql())
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verify(table(spark, sf, "documents"))


def fim_sql() -> str:
    cut = {i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)" for i in range(4)}
    return rf"""
    WITH
      d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                   sha256('7:' || doc_id) AS h FROM documents),
      c AS (SELECT *, len(u) AS n, least({cut[0]} % (len(u) + 1), {cut[1]} % (len(u) + 1)) AS lo,
                   greatest({cut[0]} % (len(u) + 1), {cut[1]} % (len(u) + 1)) AS hi,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {cut[2]} % 100 >= 100 THEN 'plain'
                        WHEN {cut[3]} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
      p AS (SELECT *, array_to_string(u[1 : lo], '') AS pre, array_to_string(u[lo + 1 : hi], '') AS mid,
                   array_to_string(u[hi + 1 : n], '') AS suf FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
    """


@query(fim_sql())
def op12_fim(spark: SparkSession, sf: str) -> DataFrame:
    made = fim.transform(table(spark, sf, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query(
    r"""
    WITH
      d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS u FROM documents),
      l AS (SELECT doc_id, unnest(u) AS line, unnest(range(0, len(u))) AS pos FROM d),
      k AS (SELECT *, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '\A[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+\z', '') AS key FROM l),
      f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
      m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """
)
def op13_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
