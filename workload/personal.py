"""Personal data in the given documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import pii
from workload import tables
from workload.registry import query

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  (CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) * (1 + (i - 1) % 2)) // 10 + (CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) * (1 + (i - 1) % 2)) % 10)) % 10 = 0"""
_BARE = "replace(v, ' ', '')"
_MOD97 = f"""length({_BARE}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(range(1, length({_BARE}) + 1), lambda i:
  strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(substr({_BARE}, 5) || substr({_BARE}, 1, 4), i, 1)) - 1)),
  lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"""
_SQL_RULES = {
    "secret": "regexp_matches(substr(v, 8), '[0-9]') AND regexp_matches(regexp_replace(v, '^[^=:]*[=:]', ''), '[A-Za-z]')",
    "email": "NOT contains(v, '..') AND NOT contains(v, '.@')",
    "iban": _MOD97,
    "card": _LUHN,
    "ip": "len(string_split(v, '.')) = 4 AND list_max(list_transform(string_split(v, '.'), lambda x: CAST(x AS INTEGER))) <= 255",
    "phone": f"NOT regexp_full_match(v, '{pii.DAY}') AND length({_DIGITS}) BETWEEN 7 AND 15 AND (v LIKE '+%' OR contains(v, '(') OR len(regexp_extract_all(v, '[ .-]')) >= 2)",
}


def _spans_sql() -> str:
    """Candidates by pattern with offsets from the gaps between them; kinds accepted one after the other."""
    steps, kept = [], []
    for kind, pattern in pii.PATTERNS.items():
        p = pattern.replace("'", "''")
        steps.append(
            f"""c_{kind} AS (SELECT id, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY id ORDER BY n) AS INTEGER) AS b
              FROM (SELECT doc_id AS id, unnest(h) AS v, unnest(g[1 : len(h)]) AS g, unnest(range(0, len(h))) AS n
                    FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS h,
                                 string_split(regexp_replace(text, '{p}', chr(1), 'g'), chr(1)) AS g FROM documents)))"""
        )
        apart = " ".join(f"AND NOT EXISTS (SELECT 1 FROM k_{o} o WHERE o.id = c.id AND o.a < c.b AND c.b - length(c.v) < o.b)" for o in kept)
        steps.append(f"k_{kind} AS (SELECT id, CAST(b - length(v) AS INTEGER) AS a, b, v FROM c_{kind} c WHERE {_SQL_RULES[kind]} {apart})")
        kept.append(kind)
    union = " UNION ALL ".join(f"SELECT id, a, b, v, '{kind}' AS kind FROM k_{kind}" for kind in kept)
    return f"WITH {', '.join(steps)}, spans AS ({union})"


@query(f"""{_spans_sql()} SELECT id AS doc_id, a AS start, b AS "end", kind AS category, v AS value FROM spans""")
def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_spans(tables.table(spark, sf, "documents"), "doc_id")


@query(f"""{_spans_sql()},
covered AS (SELECT id, unnest(range(a + 1, b + 1)) AS p FROM spans),
letters AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS p, text FROM documents WHERE doc_id IN (SELECT id FROM spans)),
hidden AS (SELECT doc_id, string_agg(CASE WHEN c.p IS NULL THEN substr(text, l.p, 1) ELSE '*' END, '' ORDER BY l.p) AS masked
           FROM letters l LEFT JOIN covered c ON c.id = doc_id AND c.p = l.p GROUP BY doc_id),
kinds AS (SELECT id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM spans GROUP BY id)
SELECT d.doc_id, kinds IS NOT NULL AS attr_pii_has_pii, coalesce(kinds, '') AS attr_pii_categories, sha256(coalesce(masked, text)) AS masked_sha256
FROM documents d LEFT JOIN kinds ON id = d.doc_id LEFT JOIN hidden h ON h.doc_id = d.doc_id""")
def pii_tags(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", "text").withColumn("spans", pii.spans(F.col("text")))
    hidden = docs.withColumn("masked", pii.masked(F.col("text"), F.col("spans")))
    return hidden.select(
        "doc_id",
        (F.size("spans") > 0).alias("attr_pii_has_pii"),
        F.array_join(F.sort_array(F.array_distinct(F.col("spans.category"))), ",").alias("attr_pii_categories"),
        F.sha2("masked", 256).alias("masked_sha256"),
    )
