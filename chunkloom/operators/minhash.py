"""Near-duplicate tagging: MinHash signatures, banding, clusters per source."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.plans.components import connected_components
from chunkloom.plans.ranking import rank_in_group
from chunkloom.session import materialize

# The published MinHash parametrisation whose signatures these
# must equal (permutations from a seeded generator over a Mersenne prime, 32-bit
# hashes from the first four bytes of SHA-1), and the banding that minimises the
# summed false-positive and false-negative area at threshold 0.85.
NUM_PERM = 128
SEED = 1
MERSENNE_PRIME = (1 << 61) - 1
MAX_HASH = (1 << 32) - 1
BANDS = 8
ROWS_PER_BAND = 16
SHINGLE_WORDS = 3


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash permutations."""
    draw = np.random.RandomState(SEED)
    pairs = np.array(
        [
            (
                draw.randint(1, MERSENNE_PRIME, dtype=np.uint64),
                draw.randint(0, MERSENNE_PRIME, dtype=np.uint64),
            )
            for _ in range(NUM_PERM)
        ],
        dtype=np.uint64,
    )
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _permute(hashes: np.ndarray, mult: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Low 32 bits of (mult * hash + off mod 2^64) mod 2^61-1, per permutation."""
    p = np.uint64(MERSENNE_PRIME)
    x = mult * hashes[None, :]
    x += off
    high = x >> np.uint64(61)
    x &= p
    x += high
    np.subtract(x, p, out=x, where=x >= p)
    x &= np.uint64(MAX_HASH)
    return x


def signature_column(text: Column) -> Column:
    """128 minima over the text's distinct word 3-grams; texts below three
    words share the signature of the empty set."""

    @F.pandas_udf("array<bigint>")
    def sign(texts: pd.Series) -> pd.Series:
        mult, off = (v[:, None] for v in permutations())
        empty = np.full(NUM_PERM, MAX_HASH, dtype=np.int64)

        def one(value: str | None) -> np.ndarray:
            w = value.lower().split() if value else []
            grams = set(map(" ".join, zip(*(w[i:] for i in range(SHINGLE_WORDS)))))
            if not grams:
                return empty
            # A digest is five 32-bit words; the first is the hash.
            digests = b"".join([hashlib.sha1(g.encode()).digest() for g in grams])
            hashes = np.frombuffer(digests, dtype="<u4")[::5].astype(np.uint64)
            best = np.full(NUM_PERM, MAX_HASH, dtype=np.uint64)
            # Blocks keep the work matrix small whatever the text's length.
            for at in range(0, len(hashes), 512):
                mixed = _permute(hashes[at : at + 512], mult, off)
                np.minimum(best, mixed.min(axis=1), out=best)
            return best.astype(np.int64)

        return texts.map(one)

    return sign(text)


def signatures(chunks: DataFrame, scope: str = "source_id") -> DataFrame:
    """(chunk_id, scope, signature), from the two needed columns only."""
    return chunks.select(
        "chunk_id", scope, signature_column(F.col("text")).alias("attr_minhash_signature")
    )


def _bands(signature: Column) -> Column:
    """96 hash bits per band of 16 minima."""
    parts = [F.slice(signature, b * ROWS_PER_BAND + 1, ROWS_PER_BAND) for b in range(BANDS)]
    return F.array(*[F.struct(F.xxhash64(p).alias("h1"), F.hash(p).alias("h2")) for p in parts])


def _shared_band_edges(signed: DataFrame, scope: str) -> DataFrame:
    """A star per shared band: every member is linked to the smallest member.

    n - 1 edges per bucket instead of n * (n - 1) / 2, with the same
    components; the smallest member is an aggregate, so a bucket of any size
    is combined before the shuffle and no task holds it whole.
    """
    bands = signed.select(
        "chunk_id", scope, F.posexplode("_bands").alias("band", "digest")
    ).select("chunk_id", scope, "band", "digest.*")
    keys = [scope, "band", "h1", "h2"]
    # Written first: with few shared bands its size shows that the join below
    # need not shuffle all bands.
    hubs = materialize(
        bands.groupBy(*keys)
        .agg(F.min("chunk_id").alias("hub"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "bands",
    )
    return (
        bands.join(hubs, keys)
        .where("chunk_id > hub")
        .select(F.col("chunk_id").alias("hi"), F.col("hub").alias("lo"))
    )


def tag_near_duplicates(chunks: DataFrame, scope: str = "source_id") -> DataFrame:
    """(chunk_id, scope, signature, cluster id, is_head) for every chunk.

    Chunks of one ``scope`` value that share a band are neighbours, clusters
    are the transitive closure; the head is the smallest chunk id, labels count
    from 0 in the order of the heads.
    """
    signed = materialize(
        signatures(chunks, scope).withColumn("_bands", _bands(F.col("attr_minhash_signature"))),
        "signatures",
    )
    # Clusters and labels are worked out on narrow rows; the signatures join
    # once, at the end.
    roots = connected_components(_shared_band_edges(signed, scope))
    ids = signed.select("chunk_id", scope)
    headed = ids.join(roots, ids.chunk_id == roots.node, "left").select(
        "chunk_id", scope, F.coalesce("root", "chunk_id").alias("_head")
    )
    heads = rank_in_group(
        headed.where("chunk_id = _head").select(scope, "_head"),
        [scope],
        ["_head"],
        "attr_minhash_cluster_id",
    )
    labels = headed.join(heads, [scope, "_head"]).select(
        "chunk_id",
        "attr_minhash_cluster_id",
        (F.col("chunk_id") == F.col("_head")).alias("attr_minhash_is_head"),
    )
    return signed.drop("_bands").join(labels, "chunk_id")
