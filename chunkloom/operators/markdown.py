"""Linearising document trees to Markdown, as one narrow Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A node waiting to be opened, and a line block that is done: ``path`` is the
# position in the tree, so sorting by it gives depth-first order.
_NODES = "array<struct<path:array<int>,node:variant>>"
_BLOCKS = "array<struct<path:array<int>,lines:array<string>>>"


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _row(cells: Column) -> Column:
    # A null cell is an empty one; it keeps its place.
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def _node_lines(node: Column, level: Column) -> Column:
    """The lines of one node; ``level`` is 0 for a top node."""
    kind = _text(node, "$.type")
    text = _text(node, "$.text")
    title = _text(node, "$.title")
    table = F.try_variant_get(node, "$.data", "variant")
    rows = F.coalesce(
        F.try_variant_get(node, "$.data.rows", "array<array<string>>"),
        F.array(F.array().cast("array<string>")),
    )
    header = F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---|"), F.size(header)), "|"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), _row)
    items = F.coalesce(
        F.try_variant_get(node, "$.items", "array<variant>"), F.array().cast("array<variant>")
    )
    item_lines = F.transform(
        F.filter(items, lambda i: _text(i, "$.text").isNotNull()),
        lambda i: F.concat(F.lit("- "), _text(i, "$.text")),
    )
    blank = F.array(F.lit(""))
    return (
        F.when((kind == "text") & text.isNotNull(), F.array(text))
        .when(
            (kind == "section_header") & title.isNotNull(),
            F.array(
                F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), level + 2)), F.lit(" "), title),
                F.lit(""),
            ),
        )
        .when(
            (kind == "table") & table.isNotNull(),
            F.concat(F.array(_row(header), rule), body, blank),
        )
        .when(
            kind == "image",
            F.array(F.concat(F.lit("[Image: "), F.coalesce(_text(node, "$.id"), F.lit("img")), F.lit("]"))),
        )
        .when(
            (kind == "code") & text.isNotNull(),
            F.array(
                F.concat(F.lit("```"), F.coalesce(_text(node, "$.language"), F.lit(""))),
                text,
                F.lit("```"),
                F.lit(""),
            ),
        )
        .when(kind == "list", F.concat(item_lines, blank))
        .otherwise(F.array().cast("array<string>"))
    )


def _nodes(children: Column, path: Column) -> Column:
    """Children of one node with their positions."""
    return F.transform(
        F.coalesce(children, F.array().cast("array<variant>")),
        lambda c, i: F.struct(F.concat(path, F.array(i)).alias("path"), c.alias("node")),
    )


def _children(node: Column) -> Column:
    return F.try_variant_get(node, "$.children", "array<variant>")


def render_markdown(documents: DataFrame, *, title: bool = True) -> DataFrame:
    """Add ``markdown`` to ``documents(doc_json, ...)``; NULL if unparsable.

    The tree is opened level by level inside each row: the state holds the
    nodes still closed and the lines already made, and one step opens all
    closed nodes.  Rows never meet, so nothing is shuffled.  Document children
    come before pages, pages in the order of the file; with ``title`` the name
    leads.
    """
    tree = documents.withColumn("_doc", F.try_parse_json("doc_json"))
    # A map keeps the file's page order, which a variant object does not.
    pages = F.from_json(F.get_json_object("doc_json", "$.pages"), "map<string,string>")
    top = F.array(F.lit(0))
    page_nodes = F.flatten(
        F.transform(
            F.coalesce(F.map_values(pages), F.array().cast("array<string>")),
            lambda p, i: _nodes(
                _children(F.try_parse_json(p)), F.array(F.lit(1), i)
            ),
        )
    )
    empty_blocks = F.array().cast(_BLOCKS)
    opened = tree.withColumn(
        "_top", F.concat(_nodes(_children(F.col("_doc")), top), page_nodes).cast(_NODES)
    ).withColumn(
        # Each level lies in a list of its own, so lists bound the levels; steps
        # with nothing left to open do nothing.
        "_steps", F.regexp_count("doc_json", F.lit(r"\[")) + 1
    )
    start = F.struct(F.col("_top").alias("closed"), empty_blocks.alias("done"))

    def level(path: Column) -> Column:
        # The path starts with [0, i] for the document, [1, page, i] for a page.
        return F.size(path) - 2 - F.get(path, F.lit(0))

    def step(state: Column, _: Column) -> Column:
        closed = state["closed"]
        lines = F.transform(
            closed,
            lambda n: F.struct(
                n["path"].alias("path"), _node_lines(n["node"], level(n["path"])).alias("lines")
            ),
        )
        inner = F.flatten(F.transform(closed, lambda n: _nodes(_children(n["node"]), n["path"])))
        return F.when(
            F.size(closed) > 0,
            F.struct(
                inner.cast(_NODES).alias("closed"),
                F.concat(state["done"], lines).cast(_BLOCKS).alias("done"),
            ),
        ).otherwise(state)

    blocks = opened.withColumn(
        "_blocks",
        F.aggregate(F.sequence(F.lit(1), F.col("_steps")), start, step, lambda state: state["done"]),
    )
    name = _text(F.col("_doc"), "$.name")
    head = (
        F.when(name.isNotNull(), F.array(F.concat(F.lit("# "), name), F.lit("")))
        .otherwise(F.array().cast("array<string>"))
        if title
        else F.array().cast("array<string>")
    )
    lines = blocks.withColumn(
        "_lines",
        F.concat(head, F.flatten(F.transform(F.array_sort("_blocks"), lambda b: b["lines"]))),
    )
    last = F.array_max(F.transform("_lines", lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    text = F.concat(F.array_join(F.slice("_lines", 1, F.coalesce(last, F.lit(0))), "\n"), F.lit("\n"))
    return lines.withColumn("markdown", F.when(F.col("_doc").isNotNull(), text)).drop(
        "_doc", "_top", "_steps", "_blocks", "_lines"
    )
