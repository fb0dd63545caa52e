"""Prompt templates: ``{field}`` placeholders compiled to one concat."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """A template names a field the rows do not have."""


def render(template: str, fields: dict[str, Column]) -> Column:
    """The template as a Column; ``{{`` and ``}}`` stand for braces.

    A NULL field prints as ``None``, as in Python formatting.
    """
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name not in fields:
            raise TemplateError(f"no column {name!r} for the placeholder in the template")
        if spec or conversion:
            raise TemplateError(f"a placeholder takes no format options: {name!r}")
        parts.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")
