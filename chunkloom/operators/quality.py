"""Quality tagging: a model rates each chunk, or its length does."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.templates import render
from chunkloom.functions.text import clamp_unit, strip
from chunkloom.operators.models import BatchModel, MockModel, complete
from chunkloom.schema import TOKEN_BUDGET

# Fixed value: the scoring prompt.
SCORING_PROMPT = (
    "Rate the quality of the following text chunk on a scale from 0.0 to 1.0,\n"
    "where 1.0 is high-quality, coherent, informative text and 0.0 is garbled,\n"
    "empty, or meaningless content.\n"
    "\n"
    "Text:\n"
    "{chunk_text}\n"
    "\n"
    "Respond with ONLY a single decimal number between 0.0 and 1.0. No explanation."
)
# Answer length asked for, and the failure row.
SCORING_MAX_TOKENS = 16
FAILED = (0.0, "error")


def tag_quality(
    chunks: DataFrame, make_model: Callable[[], BatchModel] = MockModel
) -> DataFrame:
    """(chunk_id, source_id, attr_quality_score, attr_quality_provider).

    An answer that is no number, or no answer, gives (0.0, "error").
    """
    asked = chunks.select(
        "chunk_id", "source_id", render(SCORING_PROMPT, {"chunk_text": F.col("text")}).alias("prompt")
    )
    answers = complete(asked, make_model, max_tokens=SCORING_MAX_TOKENS)
    # Java would also read a type suffix, as in "0.5f".
    plain = F.when(~F.col("content").rlike(r"(?i)[0-9.][df]\s*$"), strip(F.col("content")))
    number = plain.try_cast("double")
    good = F.col("error").isNull() & number.isNotNull()
    return answers.select(
        "chunk_id",
        "source_id",
        F.when(good, clamp_unit(number)).otherwise(FAILED[0]).cast("float").alias("attr_quality_score"),
        F.when(good, F.col("model")).otherwise(FAILED[1]).alias("attr_quality_provider"),
    )


def add_quality_by_length(rows: DataFrame) -> DataFrame:
    """The rows with the scores of ``tag_quality_by_length``; narrow."""
    names = ("attr_quality_score", "attr_quality_provider")
    scores = [F.col(n) for n in names]
    kept = [c for c in rows.columns if c not in names]
    tagged = tag_quality_by_length(rows, carry=kept)
    return tagged.select(*kept, *scores)


def tag_quality_by_length(
    chunks: DataFrame, carry: Sequence[str] = ("chunk_id", "source_id")
) -> DataFrame:
    """The model-free scorer: share of the token budget that is used."""
    return chunks.select(
        *carry,
        F.least(F.lit(1.0), F.col("token_count") / F.lit(float(TOKEN_BUDGET)))
        .cast("float")
        .alias("attr_quality_score"),
        F.lit("length_heuristic").alias("attr_quality_provider"),
    )
