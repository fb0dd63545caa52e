"""Chat formatting: exact round trips."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", None),
    (1, 10, "assistant", "last\n"), (1, 9, "assistant", "\x1a\x1a0\x1a1[/INST<s></s></s>"), (2, 0, "tool", "<|role|>x<|text|>"),
    (2, 0, "tool", "<|role|>x<|text|>"), (2, 0, "assistant", "same turn"), (2, None, None, None), (None, 1, "system", "<<SYS>>é🙂"),
    (None, 0, "[INST]", "a role of its own"), (3, 0, "assistant", "<|endoftext|> long " * 30_000), (4, 0, "user", ""), (5, 0, "", "x"),
]


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), digest(said), len(learned), digest(learned)))
    return sorted(out, key=str)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_edge_rows(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("input_ids", F.lit(1))
    got = chat.read_back(chat.format_turns(turns.repartition(5), PATH), PATH).drop("formatted_chars").collect()
    assert sorted(map(tuple, got), key=str) == expected(TURNS)


def test_one_row_a_batch_gives_the_same(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 1)
    try:
        got = chat.read_back(chat.format_turns(turns, PATH), PATH).drop("formatted_chars").collect()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, got), key=str) == expected(TURNS)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(turns, PATH), PATH).count() == 0


def test_only_assistant_texts_count_for_the_loss(spark):
    turns = spark.createDataFrame(TURNS[:6], "conv_id long, turn long, role string, text string")
    codec = chat.Codec(PATH)
    for r in chat.format_turns(turns, PATH).collect():
        assert len(r.input_ids) == len(r.loss_mask)
        learned = [i for i, m in zip(r.input_ids, r.loss_mask) if m]
        assert not set(learned) & set(codec.names)
        assert bool(learned) == (r.turn in (1, 9, 10))
        assert sum(i in codec.names for i in r.input_ids) == 2


@given(st.lists(st.sampled_from(["\x1a", "0", "1", *"".join(chat.CONTROLS), *chat.CONTROLS])).map("".join))
def test_escaping_is_reversible_and_breaks_control_strings(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


@pytest.mark.parametrize("flags", [[True], [False, True, False], [True, True], [False]])
def test_masks_are_prefix_sums_over_borders(flags):
    segments = [(list(range(n)), f) for n, f in enumerate(flags)]
    ids, mask = chat.assemble(segments)
    assert ids == [i for s, _ in segments for i in s]
    assert mask == [int(f) for s, f in segments for _ in s]
