"""Best-fit packing: length-histogram planning.

The only thing planned centrally is the histogram of piece lengths, at most
``capacity`` numbers.  Best-fit decreasing runs over its counts: all pieces of one length
go, many at a time, into the fullest open sequences that still take them, or
open new ones.  The plan is a list of runs (length, ranks, sequences, offset)
whose number depends on the capacity, not on the documents.  Pieces are ranked
within their length (spread over tasks, however common a length is) and join
the planned slot with their length and rank.

Null and empty texts are a document of the one separator token.  Repeated rows
are packed once each.  Documents without an id are packed like others.  Other
columns are ignored; ``ids`` keeps the tokens themselves where asked for.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import byte_slices
from chunkloom.plans.ranking import rank_in_group
from chunkloom.session import materialize

CAPACITY = 2048
SEPARATOR = 0
# Words encoded in one text, and bytes of texts whose distinct words are.
JOINED_WORDS = 1000
SLICE = 4 << 20
# Texts that the tokenizer holds the full encodings of at a time.
AT_ONCE = 16
# Words whose parts can be counted: no combining marks, only letters with one lower case.
PLAIN_WORD = r"^[\x21-\x7E\x{C0}-\x{12F}\x{131}-\x{24F}]+$"
# Fixed value: how the vocabulary's tokenizer splits lower-cased text.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+"
# Ranks that one row of the plan may cover before it is split.
RUN_ROWS = 100_000


def word_encoder(path: str) -> Callable:
    """An encoder for the vocabulary of lower-case words with word ends, which drops
    white space and never joins parts across it.

    Each distinct word of a batch is encoded once: many in one text, apart again by
    the tokens that end a part.  Texts with combining marks (or the one letter that
    becomes one in lower case) or special tokens are encoded whole, and words of scripts beyond extended Latin one by one.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # Tasks are the parallelism; threads of a task's own would each keep memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends_part = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_part[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def lists_of(texts: list[str]):
        """Ids of all texts in a row, and how many each has."""
        ids = [
            np.asarray(e.ids, np.uint32)
            for a in range(0, len(texts), AT_ONCE)
            for e in tokenizer.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)
        ]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate(ids or [np.empty(0, np.uint32)]), sizes

    def encode_words(words: pa.Array):
        plain = pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False)
        parts = pc.count_substring_regex(pc.utf8_lower(words), PARTS).to_numpy(zero_copy_only=False).astype(np.int64)
        names = words.filter(pa.array(plain)).to_pylist()
        joined, _ = lists_of([" ".join(names[i : i + JOINED_WORDS]) for i in range(0, len(names), JOINED_WORDS)])
        last = np.concatenate([[-1], np.flatnonzero(ends_part[joined])])[np.cumsum(parts[plain])]
        other, other_sizes = lists_of(words.filter(pa.array(~plain)).to_pylist())
        sizes = np.empty(len(words), np.int64)
        sizes[plain], sizes[~plain] = np.diff(last, prepend=-1), other_sizes
        starts = np.empty(len(words), np.int64)
        starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
        starts[~plain] = len(joined) + np.cumsum(other_sizes) - other_sizes
        return np.concatenate([joined, other]), starts, sizes

    def encode_plain(texts: pa.Array):
        spaced = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        lists = pc.split_pattern(pc.replace_substring_regex(spaced, r"(\pL)([.,]) ", r"\1 \2 "), " ")
        words = pc.list_flatten(lists).dictionary_encode()
        flat, starts, sizes = encode_words(words.dictionary)
        index = words.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        place = np.repeat(starts[index] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return flat[place], np.diff(np.concatenate([[0], ends])[bounds])

    def encode(texts: pa.Array):
        """Token ids of all texts in a row, and the number of tokens of each text."""
        whole = pc.match_substring_regex(texts, r"<\||\pM|\x{130}").to_numpy(zero_copy_only=False)
        flat, sizes = encode_plain(texts.filter(pa.array(~whole)))
        if not whole.any():
            return flat, sizes
        other, other_sizes = lists_of(texts.filter(pa.array(whole)).to_pylist())
        counts = np.empty(len(texts), np.int64)
        counts[~whole], counts[whole] = sizes, other_sizes
        own = np.repeat(whole, counts)
        ids = np.empty(len(own), np.uint32)
        ids[~own], ids[own] = flat, other
        return ids, counts

    return encode


def _cutter(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        encode = word_encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in byte_slices(pc.binary_length(texts).to_pylist(), SLICE):
                docs = batch.column("doc_id").slice(a, b - a)
                ids, counts = encode(texts.slice(a, b - a))
                pieces = (counts + capacity) // capacity
                ends = np.cumsum(counts + 1)
                flat = np.full(int(ends[-1]), SEPARATOR, "<u4")
                text_place = np.ones(len(flat), bool)
                text_place[ends - 1] = False
                flat[text_place] = ids
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[row] + 1 - start, capacity)
                at = ends[row] - counts[row] - 1 + start
                columns = [
                    docs.take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([crc32(flat[s : s + n]) for s, n in zip(at.tolist(), length.tolist())], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cuts = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(cuts, pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces_of(docs: DataFrame, path: str, id_column="doc_id", text_column="text", capacity=CAPACITY, keep_ids=False) -> DataFrame:
    """Documents -> their pieces of at most ``capacity`` tokens (doc_id, piece, start,
    length, ids_crc32 and, with ``keep_ids``, ids)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(_cutter(path, capacity, keep_ids), schema + ", ids array<int>" * keep_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Counts by length -> runs (length, first rank, ranks, first sequence, offset).

    Rank r of a run takes sequence ``first sequence + r - first rank`` at
    ``offset``.  Open sequences are kept as blocks of consecutive numbers with
    equal room, so a length is placed in a few steps however many pieces it has.
    """
    runs, blocks, rooms, opened = [], defaultdict(list), [], 0

    def keep(first: int, count: int, room: int) -> None:
        if count and room:
            if room not in blocks or not blocks[room]:
                insort(rooms, room)
            heapq.heappush(blocks[room], (first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = heapq.heappop(blocks[room])
                if not blocks[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, opened
                count = max(1, left // (capacity // length))
                opened += count
            each = min(room // length, max(1, left // count))
            used = min(count, left // each)
            for n in range(each):
                runs.append((length, rank, used, first, capacity - room + n * length))
                rank += used
            left -= each * used
            keep(first, used, room - each * length)
            keep(first + used, count - used, room)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces -> the same rows with sequence_id and offset."""
    spark = pieces.sparkSession
    # Ranking samples its input first; the texts are not encoded again for that.
    pieces = materialize(pieces, "pieces")
    ranked = materialize(rank_in_group(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank"), "ranked")
    # At most ``capacity`` rows, whatever the number of documents.
    histogram = dict(map(tuple, ranked.groupBy("length").count().collect()))
    runs = [
        (length, rank + a, min(RUN_ROWS, n - a), first + a, offset)
        for length, rank, n, first, offset in plan(histogram, capacity)
        for a in range(0, n, RUN_ROWS)
    ]
    schema = "length long, rank long, n long, first long, offset long"
    slots = (
        spark.createDataFrame(runs, schema)
        .repartition("length", "rank")
        .select("length", "rank", "first", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
        .select("length", (F.col("rank") + F.col("i")).alias("rank"), (F.col("first") + F.col("i")).alias("sequence_id"), "offset")
    )
    return ranked.join(slots, ["length", "rank"]).drop("rank")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, **columns) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"]
    return pack(pieces_of(docs, path, capacity=capacity, keep_ids=keep_ids, **columns), capacity).select(*names)
