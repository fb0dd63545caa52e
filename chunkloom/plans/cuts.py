"""Greedy cuts of long sequences without a task for each sequence.

A greedy document takes the rows of a group in order until the next one would pass the limit.  Where one
document ends depends on where the one before ended, but where a document that begins at a given row would end
depends on sums alone: at the row that holds the offset (rows' sums before + limit).  So every row gets a pointer to
the next cut, found by equal slots of the offset axis, and pointer doubling marks what the first row of
each group reaches, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.plans.ranking import totals_in_group
from chunkloom.session import discard, materialize


def next_cuts(rows: DataFrame, limit: int) -> DataFrame:
    """``rows(group, pos, before, size)`` -> (group, pos, next): where a document beginning at a row ends.

    Rows of size 0 begin none.  ``next`` is null at the end of a group.  A slot of ``limit`` offsets is
    one window: it holds at most ``limit`` rows that begin in it, however large the group.
    """
    whole = rows.where("size > 0").withColumn("after", F.col("before") + F.col("size"))
    slot = lambda x: F.floor(x / limit)
    covers = whole.select(
        "group", "pos", "before", "after", F.explode(F.sequence(slot(F.col("before")), slot(F.col("after") - 1))).alias("slot")
    ).select(
        "group", "slot", F.greatest("before", F.col("slot") * limit).alias("at"), F.lit(0).alias("asks"),
        F.struct("pos", "after").alias("holder"), F.lit(None).cast("bigint").alias("pos"),
    )
    reach = F.greatest(F.col("before") + limit, F.col("after"))
    asked = whole.select(
        "group", slot(reach).alias("slot"), reach.alias("at"), F.lit(1).alias("asks"),
        F.lit(None).cast("struct<pos:bigint,after:bigint>").alias("holder"), "pos",
    )
    order = Window.partitionBy("group", "slot").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = covers.unionByName(asked).withColumn("holder", F.last("holder", ignorenulls=True).over(order))
    return met.where("asks = 1").select(
        "group", "pos", F.when(F.col("holder.after") > F.col("at"), F.col("holder.pos")).alias("next")
    )


def reached(pointers: DataFrame) -> DataFrame:
    """``pointers(group, pos, next)`` -> (group, pos): what the least position of each group leads to, itself included.

    A round follows the pointers of all marked rows and doubles the pointers.
    """
    marked = materialize(pointers.groupBy("group").agg(F.min("pos").alias("pos")), "marked")
    jumps = materialize(pointers.where("next IS NOT NULL"), "jumps")
    while not jumps.isEmpty():
        further = marked.join(jumps, ["group", "pos"]).select("group", F.col("next").alias("pos"))
        after = jumps.select("group", F.col("pos").alias("next"), F.col("next").alias("beyond"))
        old = marked, jumps
        marked = materialize(marked.union(further), "marked")
        jumps = materialize(jumps.join(after, ["group", "next"]).select("group", "pos", F.col("beyond").alias("next")), "jumps")
        for table in old:
            discard(table)
    return marked


def greedy_cuts(rows: DataFrame, group: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """``rows`` with ``pos`` (place in the group from 0) and ``cut`` (number of its document in the group from 0).

    A row larger than ``limit`` is a document of its own; rows without a size (null, 0 or less) join the document
    before them.  Groups must not be null; ``pos``, ``cut`` and names that begin with ``_`` must be free.
    """
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    sized = rows.withColumns({"_one": F.lit(1), "_size": F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")})
    placed = materialize(totals_in_group(sized, group, order, {"pos": "_one", "_before": "_size"}), "placed")
    narrow = placed.select(F.struct(*group).alias("group"), "pos", F.col("_before").alias("before"), F.col("_size").alias("size"))
    starts = reached(materialize(next_cuts(narrow, limit), "cuts")).withColumn("_starts", F.lit(1))
    flagged = placed.withColumn("group", F.struct(*group)).join(starts, ["group", "pos"], "left")
    flagged = flagged.withColumn("_starts", F.coalesce("_starts", F.lit(0))).drop("group", "_one", "_size", "_before")
    counted = totals_in_group(flagged, group, ["pos"], {"_cuts": "_starts"})
    # What stands before the first sized row belongs to the first document.
    cut = F.greatest(F.col("_cuts") + F.col("_starts") - 1, F.lit(0))
    return counted.select(*rows.columns, "pos", cut.alias("cut"))
