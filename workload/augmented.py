"""Augmented rows of the given documents' chunks, written to a chunk table and walked by lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.operators import augment
from chunkloom.plans import lineage
from chunkloom.session import scratch_path
from chunkloom.sources.chunk_table import ChunkTable
from workload import tables
from workload.registry import CHUNKS, query

DROP = augment.word_drop(0.15, outputs=2, seed=3)
SWAP = augment.word_swap(0.3, seed=4)
SCRIPT = augment.script(dict(zip("äöüéèêñ", "aoueeen")), "plain_letters", "plain")


def _draw_sql(seed: int, output: str, place: str, parent: str = "chunk_id") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {parent} || ':' || {output} || ':' || {place}), 1, 8) AS BIGINT) % 1000"


def _made_sql() -> str:
    t = r"regexp_extract_all(text, '\s*\S+(?:\s+\z)?')"
    swap = f"""array_to_string(list_transform(w, lambda x, i: CASE WHEN {_draw_sql(4, "0", "((i - 1) // 2)")} < 300
                 AND (i % 2 = 0 OR i < len(w)) THEN replace(x, b[i], b[CASE WHEN i % 2 = 0 THEN i - 1 ELSE i + 1 END]) ELSE x END), '')"""
    return f"""{CHUNKS},
    w AS (SELECT *, {t} AS w, list_transform({t}, lambda x: regexp_replace(x, '\\s+', '', 'g')) AS b FROM chunks),
    d AS (SELECT chunk_id || '_drop' || n AS id, chunk_id AS parent, source_id,  text AS old,
                 array_to_string(list_filter(w, lambda x, i: {_draw_sql(3, "n", "(i - 1)")} >= 150), '') AS made
          FROM w, (SELECT unnest([0, 1]) AS n)),
    s AS (SELECT chunk_id || '_swap' AS id, chunk_id AS parent, source_id, text AS old, {swap} AS made FROM w),
    one AS (SELECT * FROM d WHERE made <> old UNION ALL SELECT * FROM s WHERE made <> old),
    p AS (SELECT id || '_plain' AS id, id AS parent, source_id, made AS old, translate(made, 'äöüéèêñ', 'aoueeen') AS made FROM one WHERE id LIKE '%_swap'),
    made AS (SELECT id, parent, source_id, made FROM one UNION ALL SELECT id, parent, source_id, made FROM p WHERE made <> old)"""


def stored(spark: SparkSession, sf: str) -> ChunkTable:
    """Chunks, two kinds of augmented rows, and a third made from one of these; two of the runs are repeated."""
    table = ChunkTable(spark, scratch_path(spark, "augmented"), buckets=4)
    table.replace_rows(tables.chunks(spark, sf))
    augment.run_augmenter(table, DROP)
    augment.run_augmenter(table, SWAP)
    augment.run_augmenter(table, SCRIPT, producers=(SWAP.asset,))
    augment.run_augmenter(table, SWAP)
    augment.run_augmenter(table, SCRIPT, producers=(SWAP.asset,))
    return table


@query(f"""WITH {_made_sql()}
SELECT id AS chunk_id, parent AS augmented_from, source_id, made AS text, CAST(len(regexp_extract_all(made, '\\S+')) AS INTEGER) AS token_count FROM made""")
def augmented_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf).read().where("augmented_from IS NOT NULL")
    return rows.select("chunk_id", "augmented_from", "source_id", "text", "token_count")


@query(f"""WITH {_made_sql()},
depths AS (SELECT m.id, 2 + count(p.id) AS n FROM made m LEFT JOIN made p ON p.id = m.parent GROUP BY m.id)
SELECT id AS chunk_id, 'ok' AS status, CAST(n AS INTEGER) AS n_entries, regexp_extract(id, '^\\d+_\\d+') AS root_id FROM depths
UNION ALL SELECT chunk_id, 'ok', 1, chunk_id FROM chunks""")
def augmented_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of every stored row, original and augmented."""
    return lineage.chains(stored(spark, sf).read()).selectExpr("chunk_id", "status", "size(entries) AS n_entries", "root_id")
