"""Embedding near-duplicates: cross-polytope hashing with multiprobe buckets.

Equal vectors under one label form a class.  Each table applies random signs and fast
Hadamard transforms three times and takes the nearest signed axis; ``ROTATIONS``
axes make a code.  A class enters the bucket of its code and those where one
axis is its second nearest, so neighbours meet across cell borders.  Pairs in a
bucket are verified by cosine in double precision.  A pair that meets in several
buckets counts in the first it has in common, so no list of pairs is made; a
bucket gives a count and a root for each member.  Large buckets are split into
pairs of blocks.

Only vectors with equal, non-null labels and equal lengths are compared.  Null, empty and
zero vectors and those with null or non-finite components link with nothing.
Repeated rows are vectors of their own and link with each other.  A null vec_id is never
the smallest id of a component unless there is no other.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from chunkloom.plans.components import connected_components
from chunkloom.session import materialize

THRESHOLD = 0.93
TABLES = 12
ROTATIONS = 3
PROBES = ROTATIONS + 1
BLOCK = 1024


def usable(vector: Column) -> Column:
    """Vectors that have a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(rows):
    """The fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = _butterfly(pairs).reshape(n, width)
        step *= 2
    return rows


def _butterfly(pairs):
    import numpy as np

    a, b = pairs[:, :, 0], pairs[:, :, 1]
    return np.stack([a + b, a - b], axis=2)


def codes_of(vectors):
    """Codes (n, TABLES * PROBES) of unit vectors (n, d)."""
    import numpy as np

    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    rng, rows = np.random.default_rng(11), np.arange(n)
    out = np.empty((n, TABLES, PROBES), np.int64)
    for t in range(TABLES):
        best, second = [], []
        for _ in range(ROTATIONS):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            for axes in (best, second):
                top = size.argmax(axis=1)
                axes.append(2 * top + (y[rows, top] < 0))
                size[rows, top] = -1
        for p in range(PROBES):
            code = np.full(n, t, np.int64)
            for r in range(ROTATIONS):
                code = code * (2 * width) + (second if p == r + 1 else best)[r]
            out[:, t, p] = code
    return out.reshape(n, TABLES * PROBES)


def unit_rows(vectors: pd.Series):
    """Unit vectors of equal length, as a matrix in double precision."""
    import numpy as np

    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


@F.pandas_udf(ArrayType(LongType()))
def codes(vectors: pd.Series) -> pd.Series:
    """The bucket codes of each vector."""
    lengths = vectors.map(len)
    parts = [pd.Series(list(codes_of(unit_rows(g))), index=g.index) for _, g in vectors.groupby(lengths)]
    return pd.concat(parts).reindex(vectors.index) if parts else pd.Series([], dtype=object)


@F.pandas_udf(ArrayType(DoubleType()))
def unit(vectors: pd.Series) -> pd.Series:
    """Vectors scaled to length one."""
    lengths = vectors.map(len)
    parts = [pd.Series(list(unit_rows(g)), index=g.index) for _, g in vectors.groupby(lengths)]
    return pd.concat(parts).reindex(vectors.index) if parts else pd.Series([], dtype=object)


def block_links(key, cid, weight, block, keys, vectors, one_block: bool, threshold: float):
    """Per member with links in this bucket: (cid, weight of its links that count here, root)."""
    import numpy as np

    cosine = vectors @ vectors.T >= threshold
    np.fill_diagonal(cosine, False)
    if not one_block:
        cosine &= block[:, None] != block
    i, j = np.nonzero(np.triu(cosine))
    if not len(i):
        return []
    links = np.zeros(len(cid), np.int64)
    for a in range(0, len(i), 20_000):
        x, y = i[a : a + 20_000], j[a : a + 20_000]
        x, y = np.where(cid[x] < cid[y], x, y), np.where(cid[x] < cid[y], y, x)
        shared = (keys[x][:, :, :, None] == keys[y][:, :, None, :]).any(axis=3).reshape(len(x), -1)
        first = keys[x].reshape(len(x), -1)[np.arange(len(x)), shared.argmax(axis=1)]
        x, y = x[first == key], y[first == key]
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
    root, before = cid.copy(), None
    while before is None or (before != root).any():
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
    linked = np.unique(np.concatenate([i, j]))
    return list(zip(cid[linked], links[linked], root[linked]))


def _bucket_links(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        held = None

        def close(group: pd.DataFrame):
            keys = np.stack(group["keys"]).reshape(len(group), TABLES, PROBES)
            key, lo, hi = group["key"].iat[0], group["lo"].iat[0], group["hi"].iat[0]
            columns = (group[c].to_numpy() for c in ("cid", "weight", "block"))
            return block_links(key, *columns, keys, np.stack(group["vector"]), lo == hi, threshold)

        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            marks = frame[["key", "lo", "hi"]].to_numpy()
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1)] if len(marks) else [0]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                out += close(frame.iloc[a:b])
            held = frame.iloc[cuts[-1] :]
            yield pd.DataFrame(out, columns=["cid", "links", "root"], dtype="int64")
        if held is not None and len(held):
            yield pd.DataFrame(close(held), columns=["cid", "links", "root"], dtype="int64")

    return run


def near_duplicates(
    table: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vector = F.col(vector_column).cast("array<double>")
    rows = table.select(
        F.col(id_column).alias("vec_id"),
        F.when(usable(vector) & F.col(label_column).isNotNull(), F.xxhash64(label_column, vector)).alias("cid"),
        F.col(label_column).alias("label"),
        vector.alias("embedding"),
    )
    classes = materialize(
        rows.where("cid IS NOT NULL")
        .groupBy("cid")
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.min("vec_id").alias("first"),
            F.any_value("label").alias("label"),
            F.any_value("embedding").alias("embedding"),
        ),
        "classes",
    )
    hashed = materialize(
        classes.withColumn("code", codes("embedding")).select(
            "cid",
            "weight",
            unit("embedding").alias("vector"),
            F.transform("code", lambda c: F.xxhash64(F.col("label"), F.size("embedding"), c)).alias("keys"),
        ),
        "hashed",
    )
    keys = hashed.select("cid", F.explode("keys").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = (
        keys.join(shared, "key")
        .select("key", "cid", blocks.alias("blocks"))
        .withColumn("block", F.pmod(F.hash("cid"), "blocks"))
        .select("key", "cid", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", "cid", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    found = materialize(
        members.join(hashed, "cid")
        .select("key", "lo", "hi", "cid", "weight", "block", "keys", "vector")
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
        .mapInPandas(_bucket_links(threshold), "cid long, links long, root long"),
        "links",
    )
    edges = found.where("cid != root").select(F.greatest("cid", "root").alias("hi"), F.least("cid", "root").alias("lo"))
    roots = connected_components(edges)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = materialize(
        classes.join(roots, classes.cid == roots.node, "left")
        .join(counts, "cid", "left")
        .select(
            "cid",
            "first",
            F.coalesce("root", "cid").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        ),
        "rooted",
    )
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    result = materialize(joined.join(smallest, "root").select("cid", "n_links", "component_id"), "components")
    linked = rows.select("vec_id", "cid").where("cid IS NOT NULL").join(result, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where("cid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
