"""JSON access as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A quoted literal or name (left alone), or  column ->> 'key'.
_ARROW = re.compile(
    r"""(?P<keep>'(?:[^']|'')*'|`[^`]*`(?!\s*->>))
      |(?P<col>`[^`]+`|[A-Za-z_][\w.]*)\s*->>\s*'(?P<key>(?:[^']|'')*)'""",
    re.VERBOSE,
)


def rewrite_arrows(predicate: str) -> str:
    """Turn ``col ->> 'key'`` into Spark's ``get_json_object``."""

    def swap(m: re.Match) -> str:
        if m.group("keep") is not None:
            return m.group("keep")
        return f"get_json_object({m.group('col')}, '$[\\'{m.group('key')}\\']')"

    return _ARROW.sub(swap, predicate)


def object_field(json_text: Column, key: str) -> Column:
    """A field of a JSON object as a string; NULL unless the text is a JSON
    object that has the field.

    null and booleans print as ``None``, ``True`` and ``False``; numbers,
    lists and objects keep their JSON spelling.
    """
    tree = F.try_parse_json(json_text)
    field = F.try_variant_get(tree, f"$['{key}']", "variant")
    kind = F.schema_of_variant(field)
    text = F.try_variant_get(field, "$", "string")
    printed = (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )
    return F.when(F.schema_of_variant(tree).startswith("OBJECT") & field.isNotNull(), printed)
