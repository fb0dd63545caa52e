"""Text of the given pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.sources import html
from workload import tables
from workload.registry import query


def _sql() -> str:
    """The same reading of a page in SQL: one token expression, running sums, blocks."""
    lex = html.TOKEN.replace("*+", "*").replace("++", "+").replace("'", "''")
    names = {"blocks": html.BLOCKS, "raw": html.RAW, "starts": html.CONTENT_STARTS, "heads": html.HEADINGS, "empty": html.WITHOUT_CONTENT}
    lists = {k: ", ".join(f"'{n}'" for n in v) for k, v in names.items()}
    spaces = r"[\t\n\x0B\f\r \x{A0}]+"
    anew = [(n, "page, part") for n in html.WITHOUT_CONTENT] + [(n, "page") for n in ("a", "pre", "title", *html.HEADINGS)]
    sums = ", ".join(f"sum(CASE WHEN name = '{n}' THEN turn ELSE 0 END) OVER (PARTITION BY {p} ORDER BY pos) AS sum_{n}" for n, p in anew)
    lows = ", ".join(f"sum_{n} > least(0, min(sum_{n}) OVER (PARTITION BY {p} ORDER BY pos)) AS in_{n}" for n, p in anew)
    any_of = {k: " OR ".join(f"in_{n}" for n in names[k]) for k in ("heads", "empty")}
    entity = " ".join(f"WHEN token = '&{n};' THEN '{c.replace(chr(39), chr(39) * 2)}'" for n, c in html.ENTITIES.items())
    code = "CAST(CASE WHEN regexp_matches(token, '^&#[xX]') THEN '0x' || substr(token, 4, length(token) - 4) ELSE substr(token, 3, length(token) - 3) END AS BIGINT)"
    return rf"""
    WITH
      cut AS (SELECT page_id AS page, unnest(l) AS token, unnest(range(0, len(l))) AS pos
              FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{lex}') AS l FROM pages)),
      named AS (SELECT *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS found FROM cut),
      r AS (SELECT page, pos, CASE WHEN found IN ({lists["raw"]}) THEN '' ELSE found END AS name,
                   CASE WHEN found = '' OR found IN ({lists["raw"]}) THEN 0 WHEN token LIKE '</%' THEN -1 ELSE 1 END AS turn,
                   CASE WHEN regexp_matches(token, '^&#.+;$') THEN chr(CAST({code} AS INTEGER)) {entity}
                        WHEN length(token) > 1 AND token LIKE '<%' THEN NULL ELSE token END AS piece FROM named),
      n AS (SELECT *, sum(CASE WHEN name IN ({lists["blocks"]}) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos) AS block,
                   sum(CASE WHEN name IN ({lists["starts"]}) AND turn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos) AS part FROM r),
      s AS (SELECT *, {sums} FROM n),
      d AS (SELECT *, {lows}, length(regexp_replace(coalesce(piece, ''), '{spaces}', '', 'g')) AS chars FROM s),
      e AS (SELECT *, {any_of["heads"]} AS heading, {any_of["empty"]} AS aside FROM d),
      b AS (SELECT page, block, coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT in_title AND NOT aside), '') AS body,
                   coalesce(string_agg(piece, '' ORDER BY pos) FILTER (in_title), '') AS title,
                   coalesce(sum(chars) FILTER (NOT in_title AND NOT aside), 0) AS chars,
                   coalesce(sum(chars) FILTER (NOT in_title AND NOT aside AND in_a), 0) AS link_chars,
                   coalesce(sum(chars) FILTER (aside AND NOT in_title), 0) AS aside_chars, bool_or(in_pre) AS pre, bool_or(heading) AS heading
            FROM e GROUP BY page, block),
      t AS (SELECT page, block, nullif(trim(regexp_replace(title, '{spaces}', ' ', 'g')), '') AS title,
                   CASE WHEN chars > 0 AND (link_chars <= 0.5 * chars OR heading) THEN
                     CASE WHEN pre THEN regexp_replace(body, '\A[\r\n]+|\s+\z', '', 'g') ELSE trim(regexp_replace(body, '{spaces}', ' ', 'g')) END END AS line,
                   (chars > 0 AND link_chars > 0.5 * chars AND NOT heading) OR (chars = 0 AND aside_chars > 0) AS dropped FROM b),
      g AS (SELECT page, arg_min(title, block) FILTER (title IS NOT NULL) AS title, string_agg(line, chr(10) ORDER BY block) AS text,
                   count(line) AS n_blocks, count(*) FILTER (dropped) AS n_dropped FROM t GROUP BY page)
    SELECT page_id, title, coalesce(text, '') AS text, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_dropped, 0) AS n_dropped
    FROM pages LEFT JOIN g ON page = page_id
    """


@query(_sql())
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(tables.table(spark, sf, "pages").select("page_id", "html"))
