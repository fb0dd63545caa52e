"""Rules over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import rules
from workload import tables
from workload.registry import query

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NON_SPACE = _SPACE.replace("[", "[^", 1)


def _sql() -> str:
    """Words and n-grams as rows."""
    grams = []
    for n in rules.TOP_NGRAMS:
        grams.append(
            f"""t{n} AS (SELECT id, arg_max(c * ch, (c, ch)) AS top FROM (
              SELECT id, g, count(*) AS c, any_value(length(replace(g, chr(1), ''))) AS ch FROM (
                SELECT id, array_to_string(w[s : s + {n - 1}], chr(1)) AS g FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS s FROM d WHERE len(w) >= {n}))
              GROUP BY id, g HAVING count(*) > 1) GROUP BY id)"""
        )
    for n in rules.REPEATED_NGRAMS:
        grams.append(
            f"""r{n} AS (SELECT id, sum(length(w[p])) AS again FROM d JOIN (
              SELECT DISTINCT id, unnest(range(s, s + {n})) AS p FROM (
                SELECT id, s FROM (SELECT id, array_to_string(w[s : s + {n - 1}], chr(1)) AS g, s
                                   FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS s FROM d WHERE len(w) >= {n}))
                QUALIFY row_number() OVER (PARTITION BY id, g ORDER BY s) > 1)) USING (id) GROUP BY id)"""
        )
    joins = " ".join(f"LEFT JOIN t{n} USING (id)" for n in rules.TOP_NGRAMS) + " " + " ".join(f"LEFT JOIN r{n} USING (id)" for n in rules.REPEATED_NGRAMS)
    stops = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
    shares = {
        "mean_word_chars": "chars / len(w)",
        "symbols_per_word": r"len(regexp_extract_all(text, '#|\.\.\.|…')) / len(w)",
        "bullet_lines": f"len(list_filter(l, lambda x: regexp_matches(x, '{rules.BULLETS}'))) / len(l)",
        "ellipsis_lines": "len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…')) / len(l)",
        "alphabetic_words": r"len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) / len(w)",
        "repeated_lines": "(len(l) - len(list_distinct(l))) / len(l)",
        "repeated_line_chars": "(length(array_to_string(l, '')) - length(array_to_string(list_distinct(l), ''))) / length(array_to_string(l, ''))",
        **{f"top_{n}gram_chars": f"t{n}.top / chars" for n in rules.TOP_NGRAMS},
        **{f"repeated_{n}gram_chars": f"r{n}.again / chars" for n in rules.REPEATED_NGRAMS},
    }
    columns = ", ".join(f"coalesce(round(CAST({e} AS DOUBLE), 9), 0) AS {name}" for name, e in shares.items())
    verdict = " || ".join(
        "CASE WHEN " + " OR ".join([f"{name} < {lo}" for _ in [0] if lo is not None] + [f"{name} > {hi}" for _ in [0] if hi is not None]) + f" THEN ',{name}' ELSE '' END"
        for name, (lo, hi) in rules.LIMITS.items()
    )
    return rf"""
    WITH
      d AS (SELECT *, length(array_to_string(w, '')) AS chars FROM (
              SELECT doc_id AS id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_NON_SPACE}+') AS w,
                     list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '\A{_SPACE}+|{_SPACE}+\z', '', 'g')), lambda x: x <> '') AS l
              FROM documents)),
      {", ".join(grams)},
      m AS (SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS words, {columns},
                   CAST(len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN ({stops})))) AS BIGINT) AS stop_words
            FROM d {joins})
    SELECT *, substr({verdict}, 2) AS failed FROM m
    """


@query(_sql())
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    measured = rules.measures(tables.table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    rounded = measured.withColumns({n: F.round(n, 9) for n, kind in measured.dtypes if kind == "double"})
    return rounded.withColumn("failed", F.array_join(rules.failed_rules(), ","))
