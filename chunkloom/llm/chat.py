"""Chat formatting: token-level assembly.

Every text is encoded on its own and spliced between reserved ids, so no token ever
spans a control string and a text.  A turn is: the id that opens its role, the
text's ids, the id that ends it.  Roles other than system, user and assistant are
spelled out between ids of their own.  The loss mask is a prefix sum over
segment borders: +1 where an assistant text begins, -1 where it ends.

Control strings inside a text are escaped before encoding: the escape character
``ESCAPE`` is doubled to ``ESCAPE`` "0", and ``ESCAPE`` "1" is put behind the first character of each
control string, which breaks it.  Both are undone when reading back, for any text.

A conversation may be of any length: turns stay rows (ordered by turn, then
role, then text), and readers take them one after another from a sorted
partition.  A null text, role or turn counts as empty, empty and first.  Repeated rows are
repeated turns.  A null conv_id is a conversation of its own.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\x1a"
# Control strings and the roles they open; ids follow on the vocabulary's.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"}
CONTROLS = [*OPEN.values(), "<|role|>", "<|text|>", "</s>"]
# Turns that the tokenizer holds the full encodings of at a time.
AT_ONCE = 512
_BREAK = re.compile(r"([<\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")


def escape(text: str) -> str:
    return _BREAK.sub(rf"\1{ESCAPE}1", text.replace(ESCAPE, ESCAPE + "0"))


def unescape(text: str) -> str:
    return text.replace(ESCAPE + "1", "").replace(ESCAPE + "0", ESCAPE)


class Codec:
    """Encodes segments apart and knows the reserved ids."""

    def __init__(self, path: str):
        # Tasks are the parallelism; threads of a task's own would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Special strings in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.reserved = {c: base + n for n, c in enumerate(CONTROLS)}
        self.names = {i: c for c, i in self.reserved.items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def segments(self, ids: list[int]) -> Iterator[tuple[str, str]]:
        """(control string, text behind it) one after another."""
        cuts = [n for n, i in enumerate(ids) if i in self.names]
        for a, b in zip(cuts, [*cuts[1:], len(ids)]):
            yield self.names[ids[a]], self.decode(ids[a + 1 : b])


def assemble(segments: list[tuple[list[int], bool]]) -> tuple[list[int], list[int]]:
    """Segments (ids, counts for the loss) -> all ids and the mask."""
    import numpy as np

    sizes = np.array([len(ids) for ids, _ in segments])
    ends = np.cumsum(sizes)
    borders = np.zeros(int(ends[-1]) + 1, np.int64)
    learned = np.array([flag for _, flag in segments])
    np.add.at(borders, (ends - sizes)[learned], 1)
    np.add.at(borders, ends[learned], -1)
    return [i for ids, _ in segments for i in ids], np.cumsum(borders)[:-1].tolist()


def _formatter(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec(path)
        ids_of = {c: [i] for c, i in codec.reserved.items()}
        for batch in (b.slice(a, AT_ONCE) for b in batches for a in range(0, b.num_rows, AT_ONCE)):
            roles, texts = (["" if v is None else v for v in batch.column(c).to_pylist()] for c in ("role", "text"))
            names, bodies = codec.encode(roles), codec.encode(texts)
            turns = []
            for role, name, body in zip(roles, names, bodies):
                if role in OPEN:
                    head = [(ids_of[OPEN[role]], False)]
                else:
                    head = [(ids_of["<|role|>"], False), (name, False), (ids_of["<|text|>"], False)]
                turns.append(assemble([*head, (body, role == "assistant"), (ids_of["</s>"], False)]))
            ids, mask = zip(*turns) if turns else ((), ())
            columns = [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array(ids, pa.list_(pa.int32())),
                pa.array(mask, pa.list_(pa.int8())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "input_ids", "loss_mask"])

    return run


def _reader(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec, held = Codec(path), None

        def row(at):
            conv, turns, spoken, learned, chars, formatted = at
            return [conv, turns, spoken.hexdigest(), chars, learned.hexdigest(), formatted]

        for batch in batches:
            out = []
            convs, ids, masks = (batch.column(c).to_pylist() for c in ("conv_id", "input_ids", "loss_mask"))
            for conv, turn, mask in zip(convs, ids, masks):
                if held is None or held[0] != conv:
                    if held is not None:
                        out.append(row(held))
                    held = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, text = "", ""
                for control, body in codec.segments(turn):
                    held[5] += len(control) + len(body)
                    if control == "<|role|>":
                        role = unescape(body)
                    elif control != "</s>":
                        role = next((r for r, c in OPEN.items() if c == control), role)
                        text = unescape(body)
                learned = unescape(codec.decode([i for i, m in zip(turn, mask) if m]))
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                held[3].update(learned.encode())
                held[4] += len(learned)
            yield _table(out, batch.schema.field("conv_id").type)
        if held is not None:
            yield _table([row(held)], batch.schema.field("conv_id").type)

    def _table(rows, kind):
        columns = zip(*rows) if rows else [[]] * 6
        kinds = [kind, pa_type("int64"), pa_type("string"), pa_type("int64"), pa_type("string"), pa_type("int64")]
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def pa_type(name):
        import pyarrow as pa

        return getattr(pa, name)()

    return run


def format_turns(turns: DataFrame, path: str) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> (conv_id, turn, input_ids, loss_mask), a row per
    turn, sorted within partitions that hold whole conversations.

    A conversation's rows in that order, put together, are its training sequence.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = turns.schema["turn"].dataType.simpleString()
    return (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
        .mapInArrow(_formatter(path), f"conv_id {kind}, turn {order}, input_ids array<int>, loss_mask array<tinyint>")
    )


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Formatted turns, as ``format_turns`` leaves them -> one row per conversation: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        _reader(path),
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
