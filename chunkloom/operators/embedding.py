"""Embeddings without a model: signed feature hashing with corpus weights.

Features are the lower-cased words of a text and its pairs of neighbouring words.  A feature's digest names its place in the
vector and its sign; its weight is (1 + ln count) times (1 + ln((N + 1) / (texts with it + 1))), and vectors have
length 1.  Texts are dealt into batches of bounded size.  A batch asks once for each of its features, in sorted runs by
range of digests; the ranges add up the number of texts and answer in the same order, without the digests.  So
what is shuffled are the texts and a digest for each feature of a batch, and no feature is joined to a text.

Any number of texts and any length of text (a text is worked on in one task); chunk ids are unique, as in the
table.  A text without words, or whose weights cancel out, has a NULL vector.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import words
from chunkloom.session import large_rows, materialize

# Length of the table's vector column.
WIDTH = 1024
# A batch ends with the text that reaches one of these.
BATCH_BYTES, BATCH_TEXTS = 4 << 20, 2048
BATCHES_PER_RANGE = 2
# A scan of the batches holds so many bytes of them at a time, and a batch.
GROUP_BYTES = 16 << 20


def _deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, words) -> batches of them, numbered by partition and place."""
    from pyspark import TaskContext

    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    names = ["batch", "ids", "texts"]

    def closed():
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.binary()))], names
        )

    for batch in rows:
        for chunk_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(chunk_id)
            texts.append(text)
            size += len(text)
            if size >= BATCH_BYTES or len(ids) >= BATCH_TEXTS:
                yield closed()
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield closed()


def _features(texts: list[bytes]):
    """For each feature of each text its digest, how often the text has it, and the text's number."""
    import numpy as np
    from hashlib import md5

    digests, counts, sizes = [], [], []
    for text in texts:
        own = text.split(b" ") if text else []
        found = Counter(own)
        found.update(map(b" ".join, zip(own, own[1:])))
        digests.append(b"".join([md5(f).digest() for f in found]))
        counts += found.values()
        sizes.append(len(found))
    return np.frombuffer(b"".join(digests), "S16"), np.array(counts, np.int64), np.repeat(np.arange(len(texts)), sizes)


def _ask(ranges: int) -> Callable:
    """Batches -> for each range the batch's distinct digests, sorted, and how many of its texts have each."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for row in (r for batch in rows for r in batch.to_pylist()):
            digests, texts = np.unique(_features(row["texts"])[0], return_counts=True)
            high = np.frombuffer(digests.tobytes(), ">u4")[::4].astype(np.uint64)
            part = (high * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(part)]):
                columns = [part[a]], [row["batch"]], [digests[a:b].tobytes()], [texts[a:b].astype("<u4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "batch", "digests", "texts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The questions of one range -> how many of all texts have each feature, in the order asked."""
    import numpy as np

    asked, own = (table[c].to_pylist() for c in ("digests", "texts"))
    _, place = np.unique(np.frombuffer(b"".join(asked), "S16"), return_inverse=True)
    total = np.bincount(place, np.frombuffer(b"".join(own), "<u4")).astype("<u4")[place]
    ends = np.cumsum([len(a) // 16 for a in asked])
    return table.select(["range", "batch"]).append_column("texts", pa.array([t.tobytes() for t in np.split(total, ends[:-1])], pa.binary()))


def _vectors(total: int, width: int) -> Callable:
    """A batch and its answers -> the vectors of its texts."""

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        import numpy as np

        ids, texts = batch["ids"][0].as_py(), batch["texts"][0].as_py()
        digests, counts, text = _features(texts)
        distinct, place = np.unique(digests, return_inverse=True)
        spread = np.frombuffer(b"".join(answers.sort_by("range")["texts"].to_pylist()), "<u4")
        octets = np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, 16).astype(np.int64)
        at = sum(octets[:, i] << 8 * (5 - i) for i in range(6)) % width
        rare = np.where(octets[:, 6] >> 4 & 1, -1.0, 1.0) * (1 + np.log((total + 1) / (spread + 1.0)))
        sums = np.bincount(text * width + at[place], (1 + np.log(counts)) * rare[place], len(texts) * width).reshape(-1, width)
        length = np.sqrt((sums * sums).sum(axis=1))
        flat = (sums / np.where(length > 0, length, 1)[:, None]).astype(np.float32).ravel()
        offsets = pa.array(np.arange(0, len(flat) + 1, width), pa.int32())
        vectors = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array(length == 0))
        return pa.table({"chunk_id": pa.array(ids, pa.string()), "attr_embed_vector": vectors})

    return run


def tag_embeddings(chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """(chunk_id, attr_embed_vector) for every chunk."""
    # Words hold no blank, so this can be split again; the task's Python gets folded words only.
    folded = F.array_join(words(F.coalesce("text", F.lit(""))), " ").cast("binary")
    dealt = chunks.select("chunk_id", folded).mapInArrow(_deal, "batch long, ids array<string>, texts array<binary>")
    dealt = materialize(dealt, "batches", **large_rows(GROUP_BYTES))
    batches, total = dealt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    ranges = max(1, -(-batches // BATCHES_PER_RANGE))
    asked = dealt.select("batch", "texts").mapInArrow(_ask(ranges), "range long, batch long, digests binary, texts binary")
    answers = asked.groupBy("range").applyInArrow(_answer, "range long, batch long, texts binary")
    return (
        dealt.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(_vectors(total, width), "chunk_id string, attr_embed_vector array<float>")
    )
