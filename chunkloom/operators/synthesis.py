"""Question-answer synthesis: chunks to prompts to (instruction, output) rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.hashing import md5_mod
from chunkloom.functions.jsonx import object_field
from chunkloom.functions.templates import render
from chunkloom.functions.text import prefix
from chunkloom.operators.models import BatchModel, MockModel, complete

OnFailure = Literal["skip", "fallback", "error"]

# Default prompts, the columns a preview prompt may name, answer
# and fallback lengths, the default share of validation rows.
MATERIALIZE_PROMPT = (
    "Generate a question and answer for the following text:\n\n"
    "{chunk_text}\n\n"
    'Respond with JSON: {{"instruction": "...", "output": "..."}}'
)
PREVIEW_PROMPT = (
    "Generate an instruction-response pair from the following text.\n"
    'Respond with valid JSON: {{"instruction": "...", "output": "..."}}.\n\n'
    "Text:\n{text}"
)
PREVIEW_COLUMNS = (
    "chunk_id", "source_id", "text", "token_count", "source_refs",
    "attr_quality_score", "attr_lang_code",
)
MAX_TOKENS = 512
FALLBACK_CHARS = 200
VALIDATION_SHARE = 0.1


def prompts(chunks: DataFrame, template: str) -> DataFrame:
    """(chunk_id, text, prompt).  The template may name ``chunk_text`` or any
    preview column the chunks have; anything else is an error."""
    fields = {c: F.col(c) for c in PREVIEW_COLUMNS if c in chunks.columns}
    fields["chunk_text"] = F.col("text")
    return chunks.select("chunk_id", "text", render(template, fields).alias("prompt"))


def pairs(
    asked: DataFrame,
    make_model: Callable[[], BatchModel] = MockModel,
    *,
    max_tokens: int = MAX_TOKENS,
    on_failure: OnFailure = "skip",
) -> DataFrame:
    """(instruction, output, chunk_id) from (chunk_id, text, prompt).

    An answer that is not a JSON object with both keys is skipped, replaced by
    (start of the text, raw answer), or an error.  A failed call has no raw
    answer to fall back on and is an error under "fallback", too.
    """
    # Only a fallback needs the text after the call.
    kept = asked if on_failure == "fallback" else asked.drop("text")
    answers = complete(kept, make_model, max_tokens=max_tokens)
    read = answers.withColumn("_instruction", object_field(F.col("content"), "instruction")).withColumn(
        "_output", object_field(F.col("content"), "output")
    )
    good = F.col("error").isNull() & F.col("_instruction").isNotNull() & F.col("_output").isNotNull()
    if on_failure == "skip":
        rows = read.where(good)
        return rows.select(
            F.col("_instruction").alias("instruction"), F.col("_output").alias("output"), "chunk_id"
        )
    refused = F.raise_error(
        F.concat(
            F.lit("no instruction and output for chunk "),
            F.col("chunk_id"),
            F.lit(": "),
            F.coalesce("error", F.lit("the answer is not such a JSON object")),
        )
    ).cast("string")
    if on_failure == "error":
        instead = (refused, refused)
    else:
        answered = F.col("error").isNull()
        instead = (
            F.when(answered, prefix(F.col("text"), FALLBACK_CHARS)).otherwise(refused),
            F.when(answered, F.col("content")).otherwise(refused),
        )
    return read.select(
        F.when(good, F.col("_instruction")).otherwise(instead[0]).alias("instruction"),
        F.when(good, F.col("_output")).otherwise(instead[1]).alias("output"),
        "chunk_id",
    )


def split_of(chunk_id: Column, validation_share: float = VALIDATION_SHARE) -> Column:
    """Deterministic split by the hash of the chunk id, in whole per cents
    (rounded down: 0.29 means 28)."""
    return F.when(
        md5_mod(chunk_id, 100) < F.lit(int(validation_share * 100)), "validation"
    ).otherwise("train")
