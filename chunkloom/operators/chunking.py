"""Fixed-size chunking: documents to rows of the chunk table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import NON_SPACE, first_non_blank
from chunkloom.schema import CHUNKER_VERSION, CHUNKS_ASSET, TOKEN_BUDGET, conform
from chunkloom.session import materialize


def _window_pattern(budget: int) -> str:
    """A token is a word with the white space before it, so windows of tokens
    join back to the text; white space after the last word goes with it."""
    return rf"(?U)(?:\s*+\S++){{1,{budget}}}+(?:\s++\z)?"


def token_windows(text: Column, budget: int = TOKEN_BUDGET) -> Column:
    """The text cut into runs of at most ``budget`` tokens, without overlap."""
    return F.regexp_extract_all(text, F.lit(_window_pattern(budget)), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NON_SPACE}++"))


def _as_chunks(pieces: DataFrame, producer: str, carry: tuple[str, ...] = ()) -> DataFrame:
    now = F.current_timestamp()
    return conform(
        pieces.select(
            F.concat_ws("_", "source_id", "seq").alias("chunk_id"),
            "source_id",
            "source_collection_id",
            F.lit(producer).alias("producer_asset"),
            F.lit(CHUNKER_VERSION).alias("producer_version"),
            "text",
            "token_count",
            F.lit("").alias("docling_refs"),
            F.lit("").alias("source_refs"),
            now.alias("created_at"),
            now.alias("updated_at"),
            *carry,
        )
    )


def fixed_size_chunks(
    documents: DataFrame,
    *,
    budget: int = TOKEN_BUDGET,
    producer: str = CHUNKS_ASSET,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Chunk ``documents(source_id, source_collection_id, text)``; the columns
    in ``carry`` are copied to each chunk of their document.

    One narrow pass, no shuffle: number, text and size come from one generator.
    A text without tokens gives the single chunk ``source_{id}``.
    """
    windows = token_windows(F.coalesce("text", F.lit("")), budget)
    name = F.concat(F.lit("source_"), F.col("source_id").cast("string"))
    cut = documents.select("source_id", "source_collection_id", *carry, windows.alias("_cut"))
    named = cut.withColumn("_cut", F.when(F.size("_cut") > 0, F.col("_cut")).otherwise(F.array(name)))
    # Every window but the last is full: only last ones are counted.  Counting
    # inside the generator keeps later filters from repeating it.
    rows = F.transform(
        "_cut",
        lambda w, i: F.struct(
            i.alias("seq"),
            w.alias("text"),
            F.when(i < F.size("_cut") - 1, F.lit(budget)).otherwise(count_tokens(w)).alias("token_count"),
        ),
    )
    pieces = named.select("source_id", "source_collection_id", *carry, F.inline(rows))
    return _as_chunks(pieces, producer, carry)


def encoded_chunks(
    documents: DataFrame,
    load_encoding: Callable[[], object],
    *,
    budget: int = TOKEN_BUDGET,
    producer: str = CHUNKS_ASSET,
) -> tuple[DataFrame, DataFrame]:
    """Chunk by a sub-word encoder, loaded once per Python worker.

    ``load_encoding`` returns an object with ``encode(text)`` and
    ``decode(ids)``.  A document the encoder refuses (for instance because it
    holds a special token) fails alone: the second frame lists it with its
    error.  Returns (chunks, failures).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            out = []
            for sid, cid, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    ids = encoding.encode(text or "") or encoding.encode(f"source_{sid}")
                except Exception as exc:
                    out.append((sid, cid, None, None, None, str(exc)))
                    continue
                for seq, start in enumerate(range(0, len(ids), budget)):
                    window = ids[start : start + budget]
                    out.append((sid, cid, seq, encoding.decode(window), len(window), None))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["source_id", "source_collection_id", "seq", "text", "token_count", "error"],
            )

    pieces = documents.select("source_id", "source_collection_id", "text").mapInArrow(
        cut,
        "source_id bigint, source_collection_id bigint, seq int, text string,"
        " token_count int, error string",
    )
    # Both frames read it, and texts are to be encoded once.
    pieces = materialize(pieces, "encoded")
    good = _as_chunks(pieces.where("error IS NULL"), producer)
    return good, pieces.where("error IS NOT NULL").select("source_id", "error")


def document_text(name: Column, markdown: Column, source_id: Column) -> Column:
    """Text to chunk: the linearised document, else its name, else source_{id}."""
    return F.coalesce(
        first_non_blank(markdown, name), F.concat(F.lit("source_"), source_id.cast("string"))
    )
