"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and its complement, as Java regex (``(?U)`` makes the
# classes Unicode-aware and keeps them single fast lookups).
SPACE = r"(?U)\s"
NON_SPACE = r"(?U)\S"


def words(text: Column) -> Column:
    """Lower-cased words, split on any run of white space."""
    parts = F.split(F.lower(text), f"{SPACE}+")
    return F.filter(parts, lambda w: w != "")


def shingles(text: Column, n: int = 3) -> Column:
    """Word n-grams joined by a blank; empty for texts below n words."""
    ws = words(text)
    return F.when(
        F.size(ws) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(ws) - (n - 1)),
            lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Remove white space (all of it, not only blanks) from both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def first_non_blank(*candidates: Column) -> Column:
    """The first candidate that is neither NULL nor blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates])


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def clamp_unit(x: Column) -> Column:
    """Clamp a number to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))
