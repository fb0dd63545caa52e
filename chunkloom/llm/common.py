"""Shared pieces of the operators: row identity, text slices, words of a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Characters of a word: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same with A-Z, for texts that are lower-cased afterwards.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Bytes of text that one numpy step works on.
SLICE_BYTES = 1 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def raw_words(text: Column) -> Column:
    """Words of a text in their own case; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_ANY_CASE), F.lit(0))


def fold(key: Column, parts: int, zero_is: int) -> Column:
    """Whether the fold crc32(key as text) mod ``parts`` equals ``zero_is``; null keys: false."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % parts == zero_is, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_slices(sizes, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes together, or of one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column, lower: bool = True):
    """A string array's bytes, with A-Z lower-cased or as they are, and its row
    offsets; null: empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(column) else raw[:0]
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32 * lower
    return table[raw], offsets - offsets[0]


def byte_class(pattern_bytes: bytes):
    """A table of 256 flags: true for all bytes but the given ones."""
    import numpy as np

    flags = np.ones(256, bool)
    flags[np.frombuffer(pattern_bytes, np.uint8)] = False
    return flags


def word_spans(data, offsets, in_word):
    """Start, end and row of every maximal run of ``in_word`` bytes inside a row."""
    import numpy as np

    inside = in_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(data, starts, ends):
    """64-bit hashes of byte spans (in order, not overlapping), by prefix sums
    of a polynomial, in steps of bounded memory."""
    import numpy as np

    base, size = 0x9E3779B97F4A7C15, 1 << 20
    inverse = pow(base, -1, 1 << 64)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + size)))
        a, b = int(starts[first]), int(ends[last - 1])
        powers = np.cumprod(np.full(b - a, base, np.uint64))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        back = np.cumprod(np.full(b - a, inverse, np.uint64))
        s, e = starts[first:last] - a, ends[first:last] - a
        out[first:last] = (sums[e] - sums[s]) * back[s]
        first = last
    return mix(out)


def mix(x):
    """Finish a hash: every input bit reaches every output bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
