"""Producers of the chunk table and how each one writes.

An asset is a named function over rows.  Its category decides the write mode:
chunk producers replace the rows of their sources, taggers change columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.operators.embedding import tag_embeddings
from chunkloom.operators.language import add_language_by_stop_words, tag_language_by_stop_words
from chunkloom.operators.minhash import tag_near_duplicates
from chunkloom.operators.pii import add_pii, tag_pii
from chunkloom.operators.quality import add_quality_by_length, tag_quality, tag_quality_by_length
from chunkloom.schema import CHUNKS_ASSET
from chunkloom.session import scratch_tables
from chunkloom.sources.chunk_table import ChunkTable


@dataclass(frozen=True)
class Asset:
    name: str
    mode: Literal["row", "column"]
    run: Callable[[DataFrame], DataFrame]
    # For taggers that need no other row: the rows with the columns added.
    add: Callable[[DataFrame], DataFrame] | None = None


# Row mode takes documents, column mode takes chunks.
ASSETS: dict[str, Asset] = {
    a.name: a
    for a in (
        Asset(CHUNKS_ASSET, "row", fixed_size_chunks),
        Asset("attr_quality", "column", tag_quality),
        Asset("attr_quality_length", "column", tag_quality_by_length, add_quality_by_length),
        Asset("attr_lang", "column", tag_language_by_stop_words, add_language_by_stop_words),
        Asset("attr_pii", "column", tag_pii, add_pii),
        Asset("attr_embed", "column", tag_embeddings),
        Asset("attr_minhash", "column", tag_near_duplicates),
    )
}


def original_chunks(chunks: DataFrame) -> DataFrame:
    """What taggers see: rows of the chunker, never derived ones."""
    return chunks.where(F.col("producer_asset") == CHUNKS_ASSET)


def run_tagger(table: ChunkTable, asset: Asset | str, requested: DataFrame | None = None) -> None:
    """Tag the stored chunks of the requested (or all) sources in one job.

    Taggers that need no other row rewrite the buckets without a join by chunk.
    """
    asset = ASSETS[asset] if isinstance(asset, str) else asset
    if asset.mode != "column":
        raise ValueError(f"{asset.name} is no tagger")
    if asset.add is not None:
        table.rewrite(asset.add, producers=[CHUNKS_ASSET], requested=requested)
        return
    with scratch_tables(table.spark):
        table.merge(asset.run(original_chunks(table.read(requested))), producers=[CHUNKS_ASSET])
