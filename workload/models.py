"""Deterministic stand-ins for a model, so that answers can be checked by SQL."""

from __future__ import annotations

import json

from chunkloom.operators.models import Completion


class QuoteModel:
    """Quotes the prompt; every seventh length gives prose instead of JSON,
    every eleventh a JSON number, every thirteenth fails (unless ``steady``)."""

    def __init__(self, steady: bool = False) -> None:
        self.steady = steady

    def complete(self, prompts: list[str], max_tokens: int) -> list[Completion]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> Completion:
        n = len(prompt)
        if n % 7 == 0:
            return Completion("no json here", "quote")
        if n % 11 == 0:
            return Completion("0.5", "quote")
        if n % 13 == 0 and not self.steady:
            return Completion(error="overloaded")
        answer = {"instruction": f"Quote: {prompt[:40]}", "output": n}
        return Completion(json.dumps(answer, ensure_ascii=False), "quote")


class LengthJudge:
    """Rates a prompt by its length, at times with prose or not at all."""

    def complete(self, prompts: list[str], max_tokens: int) -> list[Completion]:
        return [self._one(len(p)) for p in prompts]

    def _one(self, n: int) -> Completion:
        if n % 11 == 0:
            return Completion("very good", "judge")
        if n % 13 == 0:
            return Completion(error="timeout")
        return Completion(f" {n % 15 / 10}\n", "judge")
