"""Merkle manifest of a table by checkpoint and recompute.

Every row is a leaf; the leaves of a group (a language) form a tree in key order, and the groups'
roots form a last tree.  A node is the hash of up to eight consecutive nodes below it.
Only every third level is persisted, as one row for each aligned subtree of 512 nodes: its
descendants on that level.  Building goes up three levels at a time: a subtree's row is hashed to its
top inside the row, and tops are dealt to the next subtrees.  Proofs go down: a subtree
gets the path above its top, regenerates its two missing levels from the stored
descendants, gives each descendant its siblings, and forgets the levels again.  So a path
is shuffled once for 512 leaves, and the whole path of a leaf exists only in the last, narrow step.

Positions come from ranges over (group, key), not from a window over a group, so a group
may hold all rows.

Defined results.  Null in a field: ``-``.  Null group: a group of its own, before all others.  Null key:
before all others in its group.  Empty and very long texts: hashed like any other, in the row.
Ties and repeated rows: rows of one key are ordered by their leaf; equal rows are leaves of their own
whose places are interchangeable.  Empty table: no proofs, no root.  Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import ascii_lower, fold
from chunkloom.plans.ranking import rank_in_group
from chunkloom.session import discard, materialize

ARITY = 8
# Levels between two persisted ones, and nodes of a subtree of that height.
LEVELS = 3
SPAN = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = "struct<before:string,after:string>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: each value behind the count of its bytes."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def _parents(nodes: Column) -> Column:
    """One level up: the hash of every eight consecutive nodes."""
    runs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda run: digest(F.array_join(F.slice(nodes, run * ARITY + 1, ARITY), "")))


def _siblings(nodes: Column, at: Column) -> Column:
    """What stands before and after a node in its run."""
    within = at % ARITY
    start = at - within
    return F.struct(
        F.array_join(F.slice(nodes, start + 1, within), "").alias("before"),
        F.array_join(F.slice(nodes, at + 2, ARITY - 1 - within), "").alias("after"),
    )


def with_levels(subtrees: DataFrame) -> DataFrame:
    """Regenerate a subtree's levels: ``level0`` are the stored nodes, ``level3`` its top.

    ``wider`` says that the tree has other subtrees on this level; such a subtree is always
    hashed to full height, the only one of a tree until one node remains.
    """
    out = subtrees.withColumn("level0", F.col("members.digest"))
    for i in range(LEVELS):
        below = F.col(f"level{i}")
        out = out.withColumn(f"grows{i}", F.col("wider") | (F.size(below) > 1))
        out = out.withColumn(f"level{i + 1}", F.when(F.col(f"grows{i}"), _parents(below)).otherwise(below))
    return out


def _subtrees(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """``nodes(tree, at, digest, ...)`` -> (tree, block, wider, members in order).

    The first node of a tree's second subtree is also announced to the first, which so learns
    that it is not the only one.
    """
    home = F.floor(F.col("at") / SPAN)
    member = F.struct("at", "digest", *carried)
    dealt = nodes.withColumn(
        "block", F.explode(F.when(F.col("at") == SPAN, F.array(home, F.lit(0))).otherwise(F.array(home)))
    )
    return dealt.groupBy("tree", "block").agg(
        F.max(F.col("at") >= SPAN).alias("wider"),
        F.sort_array(F.collect_list(F.when(home == F.col("block"), member))).alias("members"),
    )


@dataclass
class Forest:
    """The persisted levels of some trees (lowest first), and each tree's root."""

    levels: list[DataFrame]
    roots: DataFrame


def plant(nodes: DataFrame, carried: list[str] | None = None) -> Forest:
    """Build the trees of ``nodes(tree, at, digest)``; ``at`` counts from 0 in each tree."""
    levels: list[DataFrame] = []
    roots = None
    extra = carried or []
    while True:
        level = materialize(_subtrees(nodes, extra), "level")
        levels.append(level)
        tops = with_levels(level).select("tree", "block", "wider", F.element_at(f"level{LEVELS}", 1).alias("digest"))
        done = tops.where("NOT wider").select("tree", "digest")
        roots = done if roots is None else roots.union(done)
        nodes, extra = tops.where("wider").select("tree", F.col("block").alias("at"), "digest"), []
        if nodes.isEmpty():
            return Forest(levels, roots)


def paths(forest: Forest, above: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(tree, at, digest, ..., path, and ``above``'s other columns) for each lowest node.

    ``above(tree, path, ...)`` has one row for each tree, with the steps beyond its root. A path is an array of
    steps from the node up, a step holding the siblings before and after.
    """
    handed = [c for c in above.columns if c not in ("tree", "path")]
    coming = None
    for depth in range(len(forest.levels) - 1, -1, -1):
        extra = (carried or []) if depth == 0 else []
        # A tree's only subtree of a level continues at the tree's root, others at their own top.
        tops = above.withColumn("top", F.lit(-1).cast("long"))
        if coming is not None:
            tops = tops.unionByName(coming.select("tree", F.col("at").alias("top"), "path", *handed))
        subtrees = forest.levels[depth].withColumn(
            "top", F.when(F.col("wider"), F.col("block")).otherwise(F.lit(-1)).cast("long")
        )
        joined = with_levels(subtrees.join(tops, ["tree", "top"]))

        def grown(member: Column, i: Column) -> Column:
            steps, at = [], i
            for level in range(LEVELS):
                step = F.array(_siblings(F.col(f"level{level}"), at))
                steps.append(F.when(F.col(f"grows{level}"), step).otherwise(F.array().cast(f"array<{STEP}>")))
                at = F.floor(at / ARITY).cast("int")
            return F.struct(member.alias("member"), F.concat(*steps).alias("own"))

        coming = (
            joined.select("tree", F.col("path").alias("upper"), *handed, F.explode(F.transform("members", grown)).alias("node"))
            .select(
                "tree",
                *[F.col(f"node.member.{c}").alias(c) for c in ("at", "digest", *extra)],
                F.concat("node.own", "upper").alias("path"),
                *handed,
            )
        )
    return coming


def climb(start: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, start, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def siblings(path: Column) -> Column:
    """All siblings of a path in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


@dataclass
class Manifest:
    """A table's trees: one for each group, and one over the groups."""

    groups: Forest
    top: Forest
    subroots: DataFrame
    carried: list[str]


def tree_name(group: Column) -> Column:
    """A group's name as bytes to be ordered: null first, then by UTF-8."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def build(rows: DataFrame, carried: list[str]) -> Manifest:
    """The manifest of ``rows(tree, order, digest, ...)``; ``carried`` columns come back with the proofs."""
    # Written, so that drawing the ranges does not hash every row once more.
    tied = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    ranked = rank_in_group(tied, ["tree"], ["order", "digest", "tie"], "at")
    groups = plant(ranked.select("tree", "at", "digest", *carried), carried)
    subroots = materialize(groups.roots, "subroots")
    in_order = rank_in_group(subroots.withColumn("all", F.lit(0)), ["all"], ["tree"], "at")
    top = plant(in_order.select(F.col("all").alias("tree"), "at", "digest", F.col("tree").alias("name")), ["name"])
    return Manifest(groups, top, subroots, carried)


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, at, digest, ..., path, subroot, root) for every leaf."""
    steps = F.array().cast(f"array<{STEP}>")
    above = manifest.top.roots.select("tree", F.col("digest").alias("root"), steps.alias("path"))
    groups = paths(manifest.top, above, ["name"]).select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"
    )
    return paths(manifest.groups, materialize(groups, "tops"), manifest.carried)


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``documents``: a tree for each language, its leaves ordered by ``doc_id``.

    Carries ``doc_id`` and ``claimed``: the leaf that a tampered copy of the row has, where the key is in the
    fold that is tampered with, else null.
    """
    columns = {name: F.col(f"`{name}`") for name in FIELDS}
    tampered = leaf([ascii_lower(c) if name == "text" else c for name, c in columns.items()])
    rows = docs.select(
        tree_name(columns["lang"]).alias("tree"),
        columns["doc_id"].alias("order"),
        columns["doc_id"].alias("doc_id"),
        leaf(list(columns.values())).alias("digest"),
        F.when(fold(columns["doc_id"], 3, 0), tampered).alias("claimed"),
    )
    return build(rows, ["doc_id", "claimed"])


def verify(docs: DataFrame) -> DataFrame:
    """Every row's proof, and what it says of a row of which some were tampered with."""
    found = proofs(manifest(docs))
    folded = climb(F.coalesce("claimed", "digest"), F.col("path"))
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
