"""The model hook: completions for batches of prompts, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass
class Completion:
    content: str | None = None
    model: str | None = None
    input_tokens: int = 0
    output_tokens: int = 0
    error: str | None = None


class BatchModel(Protocol):
    """Completes a batch of prompts.  A failed prompt comes back with ``error``;
    after an exception the batch's prompts are asked again in halves, so that
    only those that raise by themselves fail."""

    def complete(self, prompts: list[str], max_tokens: int) -> list[Completion]: ...


class MockModel:
    """Answers ``0.5`` to everything, free of charge."""

    def complete(self, prompts: list[str], max_tokens: int) -> list[Completion]:
        return [Completion("0.5", "mock") for _ in prompts]


_ANSWER: list[tuple[str, T.DataType]] = [
    ("content", T.StringType()),
    ("model", T.StringType()),
    ("input_tokens", T.LongType()),
    ("output_tokens", T.LongType()),
    ("error", T.StringType()),
]


def _ask(model: BatchModel, prompts: list[str], max_tokens: int) -> list[Completion]:
    try:
        answers = model.complete(prompts, max_tokens)
        if len(answers) != len(prompts):
            raise ValueError("the model returned another number of answers")
        return answers
    except Exception as exc:
        if len(prompts) == 1:
            return [Completion(error=f"{type(exc).__name__}: {exc}")]
        # Halves: what answers is paid for once more at most at each level, not prompt by prompt.
        half = len(prompts) // 2
        return _ask(model, prompts[:half], max_tokens) + _ask(model, prompts[half:], max_tokens)


def complete(
    prompts: DataFrame,
    make_model: Callable[[], BatchModel] = MockModel,
    *,
    prompt: str = "prompt",
    max_tokens: int = 512,
) -> DataFrame:
    """Replace column ``prompt`` by the model's answer columns.

    The model is made once per task; a prompt's failure stays in its row.
    """
    keep = [f.name for f in prompts.schema.fields if f.name != prompt]
    schema = T.StructType(
        [prompts.schema[name] for name in keep] + [T.StructField(n, t) for n, t in _ANSWER]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            asked = batch.column(len(keep)).to_pylist()
            answers = _ask(model, asked, max_tokens)
            fields = [
                pa.array([getattr(a, n) for a in answers], pa.int64() if n.endswith("tokens") else pa.string())
                for n, _ in _ANSWER
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + fields, names=schema.names
            )

    return prompts.select(*keep, prompt).mapInArrow(run, schema)
