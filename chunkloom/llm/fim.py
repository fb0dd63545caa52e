"""Fill-in-middle transformation as a pyarrow.compute pipeline.

Each batch of texts is split into lines as one list array; the lists are flattened with the
number of their text, lines get their ordinal in the text, are filtered by the role the
ordinal gives them (before the first cut, between the cuts, after them), and are put into
lists again, which ``binary_join`` turns into one piece for each text and role.  No
step looks at one text or one line alone.

The cuts and the form come from a digest of seed and key, computed by Spark, so they
do not depend on partitioning.  Every control string occurs only where the form puts
it (texts that hold one stay plain), so ``restored`` finds the text again from output and form.

Defined results.  Null text: as an empty one.  Empty text: plain, no lines.  Very long texts:
any length; a batch is worked on in slices of bounded bytes, of which a text longer than the
bound is one.  Ties: equal cuts give an empty middle; both cuts may lie at either end.
Repeated rows: equal keys and texts give equal rows, once each.  Null key: digested as no digits.
Empty table: empty result.  Other columns are not read or returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import byte_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 7
# Of 100 texts, so many are transformed, and so many of these put the suffix first.
PERCENT = 100
SPM_PERCENT = 50
# Bytes of text in one pass of the pipeline.
STEP_BYTES = 4 << 20


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    percent: int = PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for each row of ``docs``."""
    kind = docs.schema[key].dataType
    h = draws(F.col(f"`{key}`"), seed)
    chosen = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").alias("text"),
        h[0].alias("h1"),
        h[1].alias("h2"),
        (h[2] % 100 < percent).alias("changed"),
        (h[3] % 100 < spm_percent).alias("spm"),
    )

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            sizes = _sizes(batch.column("text"))
            for first, last in byte_slices(sizes, STEP_BYTES):
                yield assemble(batch.slice(first, last - first))

    schema = f"key {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return chosen.mapInArrow(run, schema).withColumnRenamed("key", key)


def _sizes(texts) -> list[int]:
    import pyarrow.compute as pc

    return pc.add(pc.fill_null(pc.binary_length(texts), 0), 1).to_pylist()


def lines(texts):
    """Large list array of each text's lines with their line ends; none for an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(split)
    pieces, parents = pc.list_flatten(split), pc.list_parent_indices(split)
    last = pc.equal(ordinals(split), pc.subtract(pc.take(counts, parents), 1))
    none, end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
    ended = pc.binary_join_element_wise(pieces, pc.if_else(last, none, end), none)
    # What follows the last line end is a line only if it is not empty.
    real = pc.invert(pc.and_(last, pc.equal(pieces, none)))
    return regroup(ended, parents, real, len(texts))


def ordinals(lists):
    """Of each flattened value, its place in its list from 0."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parents = pc.list_parent_indices(lists).to_numpy()
    counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
    starts = np.cumsum(counts) - counts
    return pa.array(np.arange(len(parents), dtype=np.int64) - starts[parents])


def regroup(values, parents, keep, rows: int):
    """The kept values as lists again, one for each parent, in order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    counts = np.bincount(pc.filter(parents, keep).to_numpy().astype(np.int64), minlength=rows)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pc.filter(values, keep))


def assemble(batch):
    """The pipeline over one record batch (key, text, h1, h2, changed, spm)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    units = lines(texts)
    n = pc.list_value_length(units).to_numpy().astype(np.int64)
    cuts = np.stack([batch.column(h).to_numpy() % (n + 1) for h in ("h1", "h2")])
    values, parents, place = pc.list_flatten(units), pc.list_parent_indices(units), ordinals(units)
    low, high = (pc.take(pa.array(c), parents) for c in (cuts.min(axis=0), cuts.max(axis=0)))

    roles = {
        PREFIX: pc.less(place, low),
        MIDDLE: pc.and_(pc.greater_equal(place, low), pc.less(place, high)),
        SUFFIX: pc.greater_equal(place, high),
    }
    none = pa.scalar("", pa.large_string())
    piece = {role: pc.binary_join(regroup(values, parents, where, len(texts)), none) for role, where in roles.items()}
    held = pc.equal(pc.binary_length(texts), 0)
    for control in (PREFIX, SUFFIX, MIDDLE):
        held = pc.or_(held, pc.match_substring(texts, control))
    plain = pc.or_(held, pc.invert(batch.column("changed")))

    def joined(*order: str):
        return pc.binary_join_element_wise(*[x for role in order for x in (pa.scalar(role, pa.large_string()), piece[role])], none)

    spm = batch.column("spm")
    transformed = pc.if_else(spm, joined(SUFFIX, PREFIX, MIDDLE), joined(PREFIX, SUFFIX, MIDDLE))
    no_length = pa.scalar(None, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("key"),
            pa.array(n),
            pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM)),
            *[pc.if_else(plain, no_length, pc.utf8_length(piece[role]).cast(pa.int64())) for role in (PREFIX, MIDDLE)],
            pc.if_else(plain, texts, transformed).cast(pa.string()),
        ],
        names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: its pieces are what lies between the control strings."""

    def between(first: str, second: str) -> list[Column]:
        head = F.split(F.substr(output, F.lit(len(first) + 1)), second, 2)
        tail = F.split(head[1], MIDDLE, 2)
        return [head[0], tail[0], tail[1]]

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
