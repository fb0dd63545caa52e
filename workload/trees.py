"""Document tree and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.chunking import document_text, fixed_size_chunks
from chunkloom.operators.markdown import render_markdown
from chunkloom.plans import lineage
from workload import tables
from workload.registry import chunks_cte, query

_LINES = "split(text, '\n')"
_TEXT_NODES = (
    "array_join(transform({lines}, l -> to_json(named_struct('type', 'text', 'text', l))), ',')"
)


@query("""WITH d AS (SELECT doc_id, text, lang, source, n_chars, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id AS source_id, md5('# doc_' || doc_id || chr(10) || chr(10) || '## ' || l[1] || chr(10) || chr(10)
  || array_to_string(list_transform(l[2:], lambda x: x || chr(10)), '')
  || '| chars | lang |' || chr(10) || '|---||---|' || chr(10) || '| ' || n_chars || ' | ' || lang || ' |'
  || chr(10) || chr(10) || '- ' || source || chr(10) || chr(10) || '[Image: img]' || chr(10)
  || '### second' || chr(10) || chr(10)
  || '```' || lang || chr(10) || source || chr(10) || '```' || chr(10)) AS markdown_md5
FROM d""")
def render_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Render document trees with every kind of node, two levels and a page."""
    inner = _TEXT_NODES.format(lines=f"slice({_LINES}, 2, size({_LINES}))")
    doc_json = F.concat(
        F.lit('{"name": "doc_'),
        F.col("source_id").cast("string"),
        F.lit('", "pages": {"2": {"children": [{"type": "group", "children": [{"type": "section_header",'
              ' "title": "second"}]}]}, "10": {"page_no": 10, "children": ['),
        F.to_json(
            F.struct(F.lit("code").alias("type"), F.col("source").alias("text"), F.col("lang").alias("language"))
        ),
        F.lit(']}}, "children": [{"type": "section_header", "title": '),
        F.expr(f"substring(to_json(array({_LINES}[0])), 2, length(to_json(array({_LINES}[0]))) - 2)"),
        F.lit(', "children": ['),
        F.expr(inner),
        F.lit("]}, "),
        F.to_json(
            F.expr(
                "named_struct('type', 'table', 'data', named_struct('rows',"
                " array(array('chars', 'lang'), array(cast(n_chars AS string), lang))))"
            )
        ),
        F.lit(', {"type": "list", "items": ['),
        F.to_json(F.struct(F.col("source").alias("text"))),
        F.lit(', "no item"]}, {"type": "image"}, {"type": "unknown"}]}'),
    )
    docs = tables.documents(spark, sf, "lang", "source", "n_chars").select(
        "source_id", doc_json.alias("doc_json")
    )
    return render_markdown(docs).select(
        "source_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5")
    )


# Rows without text nodes stand beside the documents, with numbers of their own.
_NAMELESS, _NAMED = 1_000_000_000, 2_000_000_000
_LINEARISED = f"""(
    SELECT doc_id, lang, source, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM documents
    UNION ALL SELECT doc_id + {_NAMELESS}, lang, source, 'source_' || (doc_id + {_NAMELESS}) FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id + {_NAMED}, lang, source, 'name ' || doc_id FROM documents WHERE doc_id % 3 = 1)"""


@query(f"""WITH {chunks_cte(source=_LINEARISED)}
SELECT chunk_id, source_id, token_count, text FROM chunks""")
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to text to chunks; beside all texts some documents have a name only, some not even that."""
    docs = tables.documents(spark, sf)
    whole = F.expr("concat('{\"name\": \"unused\", \"children\": [', " + _TEXT_NODES.format(lines=_LINES) + ", ']}')")
    rows = docs.select("source_id", "source_collection_id", whole.alias("doc_json"))
    nameless = docs.where("source_id % 3 = 0").select(
        F.col("source_id") + _NAMELESS, "source_collection_id", F.lit('{"name": "  ", "children": []}')
    )
    named = docs.where("source_id % 3 = 1").select(
        F.col("source_id") + _NAMED, "source_collection_id", F.expr("concat('{\"name\": \"name ', source_id, '\"}')")
    )
    texts = render_markdown(rows.union(nameless).union(named), title=False).select(
        "source_id",
        "source_collection_id",
        document_text(
            F.get_json_object("doc_json", "$.name"), F.col("markdown"), F.col("source_id")
        ).alias("text"),
    )
    return fixed_size_chunks(texts).select("chunk_id", "source_id", "token_count", "text")


NODES = """nodes AS (SELECT 'n' || doc_id AS chunk_id,
    CASE WHEN (doc_id // 40) % 5 = 3 AND doc_id % 40 = 0 THEN NULL ELSE doc_id END AS source_id,
    CASE WHEN doc_id % 40 > 0 THEN 'n' || (doc_id - 1)
         WHEN (doc_id // 40) % 5 = 1 THEN 'n' || (doc_id + 10 + (doc_id // 200) % 25)
         WHEN (doc_id // 40) % 5 = 2 THEN 'gone' || doc_id END AS augmented_from
  FROM documents)"""
WALK = f"""RECURSIVE {NODES},
walk AS (
  SELECT chunk_id AS tip, chunk_id AS cur, 1 AS depth, [chunk_id] AS path, 'walking' AS state FROM nodes
  UNION ALL
  SELECT w.tip, coalesce(p.chunk_id, w.cur),
         CASE WHEN n.augmented_from IS NULL OR p.chunk_id IS NULL OR w.depth = 32
                OR list_contains(w.path, p.chunk_id) THEN w.depth ELSE w.depth + 1 END,
         CASE WHEN n.augmented_from IS NULL OR p.chunk_id IS NULL OR w.depth = 32
                OR list_contains(w.path, p.chunk_id) THEN w.path ELSE list_append(w.path, p.chunk_id) END,
         CASE WHEN n.augmented_from IS NULL THEN
                   CASE WHEN n.source_id IS NULL THEN 'null_source' ELSE 'ok' END
              WHEN p.chunk_id IS NULL THEN 'broken_parent'
              WHEN w.depth = 32 THEN 'too_deep'
              WHEN list_contains(w.path, p.chunk_id) THEN 'cycle' ELSE 'walking' END
  FROM walk w JOIN nodes n ON n.chunk_id = w.cur LEFT JOIN nodes p ON p.chunk_id = n.augmented_from
  WHERE w.state = 'walking'),
done AS (SELECT * FROM walk WHERE state <> 'walking')"""


@query(f"WITH {WALK} SELECT tip AS chunk_id, state AS status, len(path) AS n_entries FROM done")
def lineage_status(spark: SparkSession, sf: str) -> DataFrame:
    found = lineage.chains(tables.derived_chunks(spark, sf))
    # A cycle is noticed where it closes, so count distinct entries.
    return found.select(
        "chunk_id", "status", F.size(F.array_distinct("entries")).cast("bigint").alias("n_entries")
    )


@query(f"""WITH {WALK}
SELECT tip AS chunk_id, CAST(i AS INTEGER) AS depth, path[i] AS entry_id
FROM (SELECT tip, path, unnest(range(1, len(path) + 1)) AS i FROM done WHERE state = 'ok')""")
def lineage_chain(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.chain_entries(lineage.chains(tables.derived_chunks(spark, sf)))


@query(f"""WITH {WALK}
SELECT path[i] AS chunk_id, CAST(i - 1 AS INTEGER) AS depth, tip AS derived_id
FROM (SELECT tip, path, unnest(range(2, len(path) + 1)) AS i FROM done WHERE state = 'ok')""")
def lineage_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.descendants(lineage.chains(tables.derived_chunks(spark, sf)))


@query(f"""WITH {WALK}, roots AS (SELECT d.tip, d.state, n.source_id FROM done d
  JOIN nodes n ON n.chunk_id = d.path[-1])
SELECT r.tip AS chunk_id,
       CASE WHEN r.state = 'ok' AND r.source_id % 160 = 0 THEN 'source_missing' ELSE r.state END AS status,
       CAST(v.id AS VARCHAR) AS variant_id
FROM roots r LEFT JOIN (SELECT l_orderkey AS source_id, min(l_orderkey * 8 + 1) AS id FROM lineitem
                        WHERE l_linenumber = 1 GROUP BY l_orderkey) v
  ON v.source_id = r.source_id AND r.state = 'ok'""")
def lineage_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Chains joined to source and canonical variant; some sources are gone."""
    found = lineage.resolve(
        lineage.chains(tables.derived_chunks(spark, sf)),
        tables.sources(spark, sf).where("id % 160 <> 0"),
        tables.variants(spark, sf),
    )
    return found.select("chunk_id", "status", F.col("variant_id").cast("string"))


@query(f"""WITH {NODES} SELECT chunk_id, augmented_from FROM nodes
WHERE augmented_from IS NOT NULL AND augmented_from NOT IN (SELECT chunk_id FROM nodes)""")
def broken_parents(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.broken_parents(tables.derived_chunks(spark, sf)).select("chunk_id", "augmented_from")
