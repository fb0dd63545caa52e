"""SimHash near-duplicates: pivot distance tables.

Fingerprints meet where three of their six blocks of bits agree, which two
fingerprints with at most three differing bits always do.  Inside such a bucket
every fingerprint's Hamming distances to many reference fingerprints (pivots)
are computed once; a pair whose distances to any pivot differ by more than three
cannot be close (triangle inequality) and is discarded, and the rest is
verified.  A bucket gives a spanning forest of its links, never its pairs.

Buckets beyond ``bucket_limit`` distinct fingerprints are not compared in pairs
at all.  Each fingerprint visits all points within two bit flips; at a point,
everything within two flips links to the smallest fingerprint within one flip.
Such links are true (1 + 2 bits) and connect whatever is linked, with a fixed
number of rows for each fingerprint.

Null and empty texts and texts without words have fingerprint zero, linked like any
other.  Repeated rows are returned once each.  A null doc_id never becomes a
component_id unless the whole component has none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from chunkloom.llm.common import unused
from chunkloom.plans.components import connected_components
from chunkloom.session import materialize

MAX_BITS = 3
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
PIVOTS = 24
BUCKET_LIMIT = 2048
SHINGLE = 3
SEED = 42


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    import numpy as np
    import xxhash

    table = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    words = (text or "").encode("utf-8", "surrogatepass").translate(table).split()
    if not words:
        return 0
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for a in range(0, total, 65536):
        part = words[a : min(a + 65536, total) + SHINGLE - 1]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(min(SHINGLE, len(part)))))], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """Fingerprints of a column of texts."""
    return texts.map(fingerprint_of)


def bucket_keys(fp: Column) -> Column:
    """One key for each choice of three blocks; a shared key only proposes a pair."""
    masks, low = [], 0
    for bits in BLOCK_BITS:
        masks.append(((1 << bits) - 1) << low)
        low += bits
    keys = []
    for n, chosen in enumerate(combinations(masks, 3)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def forest(prints):
    """Links (child, parent) that span the components of one bucket's fingerprints."""
    import numpy as np

    pivots = np.random.default_rng(7).integers(0, 1 << 64, PIVOTS, np.uint64)
    distances = np.bitwise_count(prints[:, None] ^ pivots).astype(np.int8)
    rest, links = np.arange(len(prints)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.abs(distances[rest] - distances[x]).max(axis=1) <= MAX_BITS
            near[near] = np.bitwise_count(prints[rest[near]] ^ prints[x]) <= MAX_BITS
            found = rest[near]
            links += [(f, x) for f in found]
            queue += list(found)
            rest = rest[~near]
    return links


def _bucket_links(frames: Iterator) -> Iterator:
    """Rows (key, fp) sorted by key -> links (hi, lo); a bucket may span frames."""
    import numpy as np

    held_key, held = None, []

    def close():
        prints = np.unique(np.concatenate(held)).view(np.uint64) if held else np.empty(0, np.uint64)
        links = forest(prints)
        ends = prints.view(np.int64)
        return [(max(ends[a], ends[b]), min(ends[a], ends[b])) for a, b in links]

    for frame in frames:
        keys, prints = frame["key"].to_numpy(), frame["fp"].to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            if keys[a] != held_key:
                out += close()
                held_key, held = keys[a], []
            held.append(prints[a:b])
        yield pd.DataFrame(out, columns=["hi", "lo"], dtype="int64")
    yield pd.DataFrame(close(), columns=["hi", "lo"], dtype="int64")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links that connect all fingerprints (fp) within three bits, without pairs."""
    i, j = F.col("i"), F.col("j")

    def bit(n: Column) -> Column:
        return F.when(n < 64, F.call_function("shiftleft", F.lit(1).cast("long"), n)).otherwise(F.lit(0).cast("long"))

    points = (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
        .select("fp", "i", F.explode(F.sequence(i, F.lit(64))).alias("j"))
        .where("i < j OR i = 64")
        .select("fp", (j == 64).alias("inner"), F.col("fp").bitwiseXOR(bit(i)).bitwiseXOR(bit(j)).alias("point"))
    )
    anchors = points.where("inner").groupBy("point").agg(F.min("fp").alias("anchor"))
    return (
        points.join(anchors, "point")
        .where("fp != anchor")
        .select(F.greatest("fp", "anchor").alias("hi"), F.least("fp", "anchor").alias("lo"))
    )


def link_classes(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) -> links (hi, lo) with the same components as all pairs."""
    keys = prints.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = materialize(keys.join(shared, "key"), "members")
    small = (
        members.where(F.col("n") <= bucket_limit)
        .select("key", "fp")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInPandas(_bucket_links, "hi long, lo long")
    )
    large = ball_links(members.where(F.col("n") > bucket_limit).select("fp").distinct())
    return small.union(large)


def components(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``prints(doc_id, fp)`` -> ``(fp, root, component_id)``, one row for each fingerprint."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(link_classes(classes.select("fp"), bucket_limit))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(
        docs.select(F.col(id_column).alias("doc_id"), fingerprint(F.col(text_column)).alias("fp")), "prints"
    )
    return prints.join(components(prints, bucket_limit), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with only one of each group left: the one with the smallest id.

    A group without ids keeps one row, as do rows repeated with id and text.
    Columns stay as they are.
    """
    prints = materialize(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.xxhash64(text_column).alias("body"),
            fingerprint(F.col(text_column)).alias("fp"),
        ),
        "prints",
    )
    id_name, body_name = unused(docs, "_best_id"), unused(docs, "_best_body")
    best = (
        prints.join(components(prints.select("doc_id", "fp")), "fp")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("best"))
        .select(F.col("best.doc_id").alias(id_name), F.col("best.body").alias(body_name))
    )
    marked = docs.join(
        materialize(best, "kept"),
        docs[id_column].eqNullSafe(F.col(id_name)) & (F.xxhash64(docs[text_column]) == F.col(body_name)),
        "left_semi",
    )
    return marked.dropDuplicates([id_column, text_column])
