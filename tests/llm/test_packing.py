"""Packing: tokens against the tokenizer, plans and slots against their rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkloom.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

TEXTS = [
    None, "", " ", "\n\n", "Hello, World. It's  the DON'T we'll 'S x's.", "a.b,c. d,. e... f .", "tab\tnew\r\nline\x0bend\x85z\xa0y",
    "é É é É. J̌ ǰ ǰ İ i̇ İ İx", "日本語 テキスト。 чешский Текст, ΟΔΟΣ ὈΔΟΣ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "x² ½ 1234 3.14, K ſ ß ẞ Ǆ ǅ", "word " * 5000, "-- . , ' '' 's", "\x1c\x1d a​b  c", "Ωmega, Ω. x̀, y.", "🙂, 🙂. a🙂. 👩‍👩‍👧",
]


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes())) for p in range(0, len(ids), 2048)]
    return sorted(out, key=str)


def check(result, rows):
    got = result.toPandas()
    pieces = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(lambda d: d.notna(), None)
    assert sorted((tuple(None if v is None else int(v) for v in r) for r in pieces.values), key=str) == brute(rows)
    for _, g in got.groupby("sequence_id"):
        at = 0
        for offset, length in sorted(zip(g.offset, g.length)):
            assert offset == at
            at += length
        assert at <= 2048
    return got


def test_edge_texts_and_repeated_rows(spark):
    rows = [*enumerate(TEXTS), (None, "no id"), (None, None), (4, TEXTS[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("rank", F.lit(1))
    check(packing.pack_documents(docs, PATH), rows)


def test_encoder_on_random_texts():
    import pyarrow as pa

    rng, encode, tokenizer = random.Random(3), packing.word_encoder(PATH), Tokenizer.from_file(PATH)
    letters = "abcXYZéÉñßİı.,'’-_|<>0123 \n\t" + "́日ж"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)]
    ids, counts = encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


def test_ids_column_holds_the_tokens(spark):
    docs = spark.createDataFrame([(1, "hello world " * 1500), (2, None)], "doc_id long, text string")
    for r in packing.pack_documents(docs, PATH, keep_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = check(queries.QUERIES["op6_packing"](spark, SF), list(map(tuple, docs)))
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


@pytest.mark.parametrize("capacity", [10, 2048])
def test_plan_places_every_rank_once(capacity):
    rng = random.Random(1)
    for size in (1, 3, 300, 20_000):
        histogram = {}
        for _ in range(size):
            length = min(capacity, int(rng.expovariate(6 / capacity)) + 1)
            histogram[length] = histogram.get(length, 0) + 1
        ranks, filled = {}, {}
        for length, rank, n, first, offset in packing.plan(histogram, capacity):
            for i in range(n):
                ranks.setdefault(length, []).append(rank + i)
                filled.setdefault(first + i, []).append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
        for places in filled.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(k * n for k, n in histogram.items())
        assert len(filled) <= 1.02 * -(-total // capacity) + 1
