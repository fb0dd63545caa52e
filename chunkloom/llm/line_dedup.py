"""Line dedup: normalised lines are exploded and hashed, distinct documents are counted
for each hash, lines of frequent hashes are dropped, and texts are put together
again by position.

Texts are split twice where they are scanned and shuffled once, at the end, to meet the
positions they lose.  In between only hashes and numbers move: a line is
(document, position, 128-bit hash of its key).  A document counts once for a hash however
often it repeats the line; these pairs are formed before the count, so a line
that every document has arrives as one small sum from each task.  The hashes
found often enough are written as a table, which makes the join back to the lines one of plain
scans, whose hot keys adaptive execution splits.

Defined results.  Null text: one empty line, returned as an empty text.  Empty text:
likewise.  Very long texts: any length; marking and filtering a text's lines is linear in
their number.  Ties and repeated rows: rows of one id are one document, so a line
occurring in these rows alone is not shared, and the smallest id keeps
all its occurrences in all its rows; each row is returned once for each time it is there.  Rows
without an id count as one document that comes after all others.  Empty table: empty
result.  Other columns are kept; the added ones (``n_lines``, ``n_dropped``, ``kept``) must not
be among them, and working columns take names that no column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import ascii_lower, unused
from chunkloom.session import materialize

SPACE = " \t\n\x0b\x0c\r"
# Shorter keys (in code points) are never dropped.
LEAST_CHARS = 10
# Keys of this many documents or more stay in the first of them only.
LEAST_DOCUMENTS = 2


def _two_hashes(value: Column) -> Column:
    """128 bits from two differently seeded hashes; unequal values do not meet in practice."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def line_keys(text: Column) -> Column:
    """The key of each line: stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)))


def shared_lines(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lines(doc, key)`` -> (key, first): keys of enough distinct documents, and the smallest of these."""
    pairs = lines.select("key", "doc").distinct()
    counted = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.min("doc").alias("first"))
    return counted.where(F.col("documents") >= least_documents).select("key", "first")


def drop_shared_lines(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and the remaining text ``kept``."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Nulls sort after all ids.
    doc = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"))
    body = _two_hashes(whole)

    cut = docs.select(doc.alias("doc"), body.alias("body"), F.posexplode(line_keys(whole)).alias("at", "line"))
    lines = materialize(
        cut.where(F.length("line") >= least_chars).select("doc", "body", "at", _two_hashes(F.col("line")).alias("key")),
        "lines",
    )
    shared = materialize(shared_lines(lines, least_documents), "shared")
    lost = lines.join(shared, "key").where(F.col("doc") != F.col("first"))
    # A set: repeated rows name the same places.
    places = materialize(
        lost.groupBy("doc", "body").agg(F.sort_array(F.collect_set("at")).alias("places")), "places"
    )

    doc_name, body_name, lost_name, lines_name, flags_name = (
        unused(docs, name) for name in ("_doc", "_body", "_lost", "_lines", "_flags")
    )
    places = places.select(F.col("doc").alias(doc_name), F.col("body").alias(body_name), F.col("places").alias(lost_name))
    marked = (
        docs.withColumns({doc_name: doc, body_name: body})
        .join(places, [doc_name, body_name], "left")
        .drop(doc_name, body_name)
        .withColumns({lines_name: F.split(whole, "\n", -1), flags_name: _flags(F.col(lost_name))})
    )
    flags = F.col(flags_name)
    stays = F.filter(F.col(lines_name), lambda line, i: ~F.coalesce(F.get(flags, i), F.lit(False)))
    return marked.select(
        *[f"`{c}`" for c in docs.columns],
        F.size(lines_name).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost_name), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(flags.isNull(), whole).otherwise(F.array_join(stays, "\n")).alias("kept"),
    )


def _flags(places: Column) -> Column:
    """Ascending places -> an array that is true at these and ends with the last; null: null."""
    gaps = F.transform(
        places,
        lambda at, i: F.concat(
            F.array_repeat(F.lit(False), (at - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1).cast("int")),
            F.array(F.lit(True)),
        ),
    )
    return F.flatten(gaps)
