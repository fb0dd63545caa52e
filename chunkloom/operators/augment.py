"""Augmenters: operators that make new chunk rows out of chunks.

An augmenter gives each chunk any number of outputs.  Output ``i`` of chunk ``p`` becomes row
``{p}_{short}`` (``{p}_{short}{i}`` if it can give several) with ``augmented_from = p``, the augmenter's id and the hash of its
configuration; all attributes are NULL, so taggers judge the new text by itself.  Rows depend only on chunk
and configuration: a run again replaces the same rows in row mode.  Rule-based augmenters are Columns, drawn
by digests of seed, chunk id, output and place; model-backed ones ask the model hook once for each output, and a
failed prompt makes no row.  A null text has no outputs; an output equal to its chunk's text makes no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.templates import render
from chunkloom.operators.chunking import count_tokens
from chunkloom.operators.models import BatchModel, complete
from chunkloom.schema import CHUNKS_ASSET, conform, config_hash
from chunkloom.sources.chunk_table import ChunkTable

VERSION = "0.1.0"
# A token is a word with the white space before it, as in chunking; white space at the end goes with the last.
TOKENS = r"(?U)\s*+\S++(?:\s++\z)?"

# Default prompts of the model-backed augmenters.
TRANSLATE = "Translate the text into {language}. Answer with the translation only.\n\n{text}"
PARAPHRASE = "Say the text in other words, keeping its meaning. Answer with the new text only. Version {version}.\n\n{text}"
PERSONA_DIALOG = "Turn the text into a dialog between {persona} and an expert. Answer with the dialog only.\n\n{text}"


@dataclass(frozen=True)
class Augmenter:
    """``outputs`` gives an array of texts for a chunk; ``most`` is how many it can have."""

    name: str
    short: str
    outputs: Callable[[], Column]
    most: int = 1
    config: dict = field(default_factory=dict)

    @property
    def asset(self) -> str:
        return f"augment_{self.name}"


def _draw(seed: int, output: int, place: Column) -> Column:
    """A number below 1000 for a place of an output."""
    key = F.concat_ws(":", F.lit(f"{seed}"), F.col("chunk_id"), F.lit(f"{output}"), place.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 1000


def _tokens() -> Column:
    return F.regexp_extract_all("text", F.lit(TOKENS), F.lit(0))


def word_drop(share: float = 0.1, outputs: int = 1, seed: int = 0) -> Augmenter:
    """Leaves out each word with probability ``share``."""
    most = round(share * 1000)

    def one(n: int) -> Column:
        return F.array_join(F.filter("_tokens", lambda w, i: _draw(seed, n, i) >= most), "")

    return Augmenter("word_drop", "drop", lambda: F.array(*[one(n) for n in range(outputs)]), outputs, {"share": share, "outputs": outputs, "seed": seed})


def word_swap(share: float = 0.1, outputs: int = 1, seed: int = 0) -> Augmenter:
    """Exchanges the words of pairs (first and second, third and fourth, ...) with probability ``share``; white space stays in place."""
    most = round(share * 1000)

    def one(n: int) -> Column:
        tokens, bare = F.col("_tokens"), F.col("_bare")

        def word(token: Column, i: Column) -> Column:
            pair = F.floor(i / 2).cast("int")
            other = i + 1 - 2 * (i % 2)
            swapped = (_draw(seed, n, pair) < most) & (other < F.size(tokens))
            return F.when(swapped, F.replace(token, F.get(bare, i), F.get(bare, other))).otherwise(token)

        return F.array_join(F.transform(tokens, word), "")

    return Augmenter(
        "word_swap", "swap", lambda: F.array(*[one(n) for n in range(outputs)]), outputs, {"share": share, "outputs": outputs, "seed": seed}
    )


def script(mapping: dict[str, str], name: str = "script", short: str = "script") -> Augmenter:
    """Converts characters one for one, for instance between scripts."""
    if not mapping or any(len(a) != 1 or len(b) != 1 for a, b in mapping.items()):
        raise ValueError("a mapping of single characters")

    def made() -> Column:
        return F.array(F.translate("text", "".join(mapping), "".join(mapping.values())))

    return Augmenter(name, short, made, 1, {"mapping": mapping})


def _rows(outputs: DataFrame, augmenter: Augmenter) -> DataFrame:
    """Chunk rows from ``outputs(chunk_id, source_id, source_collection_id, _n, _made, _old)``."""
    number = F.col("_n").cast("string") if augmenter.most > 1 else F.lit("")
    now = F.current_timestamp()
    made = outputs.where(F.col("_made").isNotNull() & (F.col("_made") != F.col("_old")))
    return conform(
        made.select(
            F.concat("chunk_id", F.lit(f"_{augmenter.short}"), number).alias("chunk_id"),
            "source_id",
            "source_collection_id",
            F.lit(augmenter.asset).alias("producer_asset"),
            F.lit(VERSION).alias("producer_version"),
            F.col("_made").alias("text"),
            count_tokens(F.col("_made")).alias("token_count"),
            F.lit("").alias("docling_refs"),
            F.lit("").alias("source_refs"),
            F.col("chunk_id").alias("augmented_from"),
            F.lit(augmenter.name).alias("augmenter_id"),
            F.lit(config_hash(augmenter.config)).alias("augmenter_config_hash"),
            now.alias("created_at"),
            now.alias("updated_at"),
        )
    )


def augment(chunks: DataFrame, augmenter: Augmenter) -> DataFrame:
    """New chunk rows, one narrow pass."""
    # Columns of their own, so that they are not worked out anew for each word.
    ready = chunks.select("chunk_id", "source_id", "source_collection_id", "text").where("text IS NOT NULL")
    ready = ready.withColumn("_tokens", _tokens()).withColumn("_bare", F.transform("_tokens", lambda t: F.regexp_replace(t, r"(?U)\s+", "")))
    each = ready.select("chunk_id", "source_id", "source_collection_id", F.col("text").alias("_old"), F.posexplode(augmenter.outputs()).alias("_n", "_made"))
    return _rows(each, augmenter)


def augment_with_model(
    chunks: DataFrame, name: str, short: str, prompt: str, make_model: Callable[[], BatchModel], *, outputs: int = 1, max_tokens: int = 512, **config
) -> DataFrame:
    """New chunk rows from a model: ``prompt`` may name chunk columns, ``{version}`` (the output's number) and keys of ``config``."""
    augmenter = Augmenter(name, short, lambda: F.array(), outputs, {"prompt": prompt, "outputs": outputs, **config})
    each = chunks.where("text IS NOT NULL").withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(outputs - 1))))
    fields = {c: F.col(f"`{c}`") for c in each.columns} | {k: F.lit(str(v)) for k, v in config.items()}
    asked = each.select(
        "chunk_id", "source_id", "source_collection_id", F.col("text").alias("_old"), F.col("version").alias("_n"), render(prompt, fields).alias("prompt")
    )
    answered = complete(asked, make_model, max_tokens=max_tokens).where("error IS NULL").withColumn("_made", F.col("content"))
    return _rows(answered, augmenter)


def run_augmenter(table: ChunkTable, augmenter: Augmenter, requested: DataFrame | None = None, producers: tuple[str, ...] = (CHUNKS_ASSET,)) -> None:
    """Make the rows of an augmenter for the stored chunks of the requested (or all) sources.

    A source that has no more outputs loses its old ones.
    """
    chunks = table.read(requested).where(F.col("producer_asset").isin(list(producers)))
    gone = chunks.select("source_id", F.lit(augmenter.asset).alias("producer_asset")).distinct()
    table.replace_rows(augment(chunks, augmenter), replace_empty=gone, derived=requested is None)
