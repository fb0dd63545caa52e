"""Hash functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(value: Column, m: int) -> Column:
    """md5 of a string, read as one 128-bit integer, modulo a small ``m``.

    128 bits do not fit a long, so the digest is folded in four 32-bit pieces
    by their place value modulo ``m``; every step stays inside code generation.
    """
    digest = F.md5(value.cast("binary"))
    total = F.lit(0).cast("bigint")
    for piece in range(4):
        number = F.conv(F.substring(digest, 8 * piece + 1, 8), 16, 10).cast("bigint")
        total = total + number * F.lit(pow(16, 8 * (3 - piece), m))
    return (total % m).cast("int")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)
