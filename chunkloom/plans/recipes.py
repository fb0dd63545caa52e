"""Recipes: preview, materialisation, versioning."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.operators import synthesis
from chunkloom.operators.models import BatchModel, MockModel
from chunkloom.plans.filters import QueryError, where
from chunkloom.session import materialize
from chunkloom.sources.dataset_sink import write_dataset

# Sample numbers of a preview, the key format of a version.
PREVIEW_SAMPLES = (3, 5)
DATASET_KEY = r"^ds_(\d+)_(v\d+)$"

SYNTHESIS_QA = "sft_synthesis_qa"


class RecipeError(ValueError):
    """A recipe that cannot be run."""


def parse_dataset_key(key: str) -> tuple[int, str]:
    m = re.match(DATASET_KEY, key)
    if not m:
        raise RecipeError(f"invalid data set key {key!r}: expected ds_<recipe>_v<n>")
    return int(m.group(1)), m.group(2)


def dataset_key_columns(key: Column) -> tuple[Column, Column]:
    """(recipe id, version tag) of a key column; NULL where malformed."""
    return (
        F.nullif(F.regexp_extract(key, DATASET_KEY, 1), F.lit("")).try_cast("bigint"),
        F.nullif(F.regexp_extract(key, DATASET_KEY, 2), F.lit("")),
    )


def source_key_column(key: Column) -> Column:
    """Source id of a ``src_<int>`` key; NULL where malformed."""
    return F.regexp_replace(key, r"^src_", "").try_cast("bigint")


def _config(definition: dict) -> dict:
    return definition.get("schema", {}).get("config", {})


def _predicate(definition: dict) -> str | None:
    return definition.get("filter", {}).get("where")


def _preview_synthesis_qa(
    sample: DataFrame, config: dict, make_model: Callable[[], BatchModel]
) -> DataFrame:
    asked = synthesis.prompts(sample, config.get("prompt_template", synthesis.PREVIEW_PROMPT))
    policy = "fallback" if config.get("fallback_on_failure", False) else "error"
    return synthesis.pairs(asked, make_model, on_failure=policy)


# Preview handlers by template name; new templates register here.
TEMPLATES: dict[str, Callable[[DataFrame, dict, Callable[[], BatchModel]], DataFrame]] = {
    SYNTHESIS_QA: _preview_synthesis_qa,
}


def preview(
    chunks: DataFrame,
    definition: dict,
    n_samples: int = 3,
    make_model: Callable[[], BatchModel] = MockModel,
) -> DataFrame:
    """Run the recipe on its first few matching chunks, strictly."""
    if not PREVIEW_SAMPLES[0] <= n_samples <= PREVIEW_SAMPLES[1]:
        raise QueryError(f"samples must be between {PREVIEW_SAMPLES[0]} and {PREVIEW_SAMPLES[1]}")
    template = definition.get("schema", {}).get("template")
    if template not in TEMPLATES:
        raise RecipeError(f"no preview for template {template!r}")
    sample = materialize(
        where(chunks, _predicate(definition))
        .select(*[c for c in synthesis.PREVIEW_COLUMNS if c in chunks.columns])
        .orderBy("source_id", "chunk_id")
        .limit(n_samples),
        "sample",
    )
    if sample.isEmpty():
        raise RecipeError("no matching chunks for preview; check the filter")
    return TEMPLATES[template](sample, _config(definition), make_model)


def dataset_rows(
    chunks: DataFrame, definition: dict, make_model: Callable[[], BatchModel] = MockModel
) -> DataFrame:
    """(split, instruction, output, chunk_id) of a recipe over all its chunks:
    filter, prompt, answer, split; one narrow plan without a shuffle."""
    config = _config(definition)
    asked = synthesis.prompts(
        where(chunks, _predicate(definition)),
        config.get("prompt_template", synthesis.MATERIALIZE_PROMPT),
    )
    rows = synthesis.pairs(
        asked,
        make_model,
        max_tokens=config.get("max_tokens", synthesis.MAX_TOKENS),
        on_failure="skip" if config.get("fallback_on_failure", True) else "error",
    )
    share = definition.get("output", {}).get("splits", {}).get(
        "validation", synthesis.VALIDATION_SHARE
    )
    return rows.select(
        synthesis.split_of(F.col("chunk_id"), share).alias("split"),
        "instruction",
        "output",
        "chunk_id",
    )


def materialize_dataset(
    chunks: DataFrame,
    definition: dict,
    root: str,
    dataset_id: int,
    version_tag: str,
    make_model: Callable[[], BatchModel] = MockModel,
    card: str | None = None,
) -> dict:
    """Publish one version of a recipe; the recipe is frozen beside the data."""
    frozen = copy.deepcopy(definition)
    return write_dataset(
        dataset_rows(chunks, frozen, make_model), root, dataset_id, version_tag, frozen, card
    )
