import pytest
from pyspark.sql import functions as F

from chunkloom.operators.chunking import document_text, encoded_chunks, fixed_size_chunks
from chunkloom.schema import CHUNK_COLUMNS, CHUNK_SCHEMA

DOC = "source_id bigint, source_collection_id bigint, text string"


def cut(spark, *texts, **options):
    docs = spark.createDataFrame([(i, 5, t) for i, t in enumerate(texts)], DOC)
    return fixed_size_chunks(docs, **options)


@pytest.mark.parametrize("n, sizes", [(1, [1]), (512, [512]), (513, [512, 1]), (1024, [512, 512]), (1300, [512, 512, 276])])
def test_window_sizes(spark, n, sizes):
    rows = cut(spark, " ".join(f"w{i}" for i in range(n))).orderBy("chunk_id").collect()
    assert [r.token_count for r in rows] == sizes
    assert [r.chunk_id for r in rows] == [f"0_{i}" for i in range(len(sizes))]


def test_windows_join_back_to_the_text(spark):
    texts = ["  a\tb\n\nc  \n", "x y　z  ", " ".join(["é"] * 1025) + "\n\n", "one"]
    rows = cut(spark, *texts, budget=2).collect()
    for i, text in enumerate(texts):
        own = sorted((int(r.chunk_id.split("_")[1]), r) for r in rows if r.source_id == i)
        assert "".join(r.text for _, r in own) == text
        assert all(r.token_count == len(r.text.split()) <= 2 for _, r in own)


def test_text_without_tokens_gives_its_name(spark):
    rows = cut(spark, "", None, " \n ").orderBy("source_id").collect()
    assert [(r.text, r.token_count) for r in rows] == [("source_0", 1), ("source_1", 1), ("source_2", 1)]


def test_row_conventions(spark):
    df = cut(spark, "a b")
    assert df.columns == CHUNK_COLUMNS and len(CHUNK_COLUMNS) == 24
    assert [f.dataType for f in df.schema] == [f.dataType for f in CHUNK_SCHEMA]
    row = df.first()
    assert (row.producer_asset, row.producer_version, row.docling_refs, row.source_refs) == ("chunks", "0.1.0", "", "")
    assert row.augmented_from is None and all(row[c] is None for c in CHUNK_COLUMNS if c.startswith("attr_"))
    assert row.source_collection_id == 5 and row.created_at is not None


def test_chunking_does_not_shuffle(spark):
    plan = cut(spark, "a b")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


class ByteEncoding:
    """One token per byte; refuses a marker, as encoders refuse special tokens."""

    def encode(self, text):
        if "<|end|>" in text:
            raise ValueError("special token")
        return list(text.encode())

    def decode(self, ids):
        return bytes(ids).decode(errors="replace")


def test_encoded_chunks_fail_alone(spark):
    docs = spark.createDataFrame([(1, None, "abcdef"), (2, 1, "x<|end|>"), (3, 1, "")], DOC)
    good, bad = encoded_chunks(docs, ByteEncoding, budget=4)
    assert sorted((r.chunk_id, r.text, r.token_count) for r in good.collect()) == [
        ("1_0", "abcd", 4), ("1_1", "ef", 2), ("3_0", "sour", 4), ("3_1", "ce_3", 4)]
    assert [(r.source_id, r.error) for r in bad.collect()] == [(2, "special token")]


def test_real_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")

    def load():
        return tiktoken.Encoding("bytes", pat_str=r".+|\s+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={"<|endoftext|>": 256})

    docs = spark.createDataFrame([(1, 1, "a" * 1025), (2, 1, "bad <|endoftext|>")], DOC)
    good, bad = encoded_chunks(docs, load)
    assert sorted(r.token_count for r in good.collect()) == [1, 512, 512]
    assert bad.count() == 1


def test_document_text_falls_back(spark):
    df = spark.createDataFrame([(1, "n", " body "), (2, " n ", " \n"), (3, " ", None), (4, None, "")], "id bigint, name string, md string")
    got = df.select("id", document_text(F.col("name"), F.col("md"), F.col("id")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == ["body", "n", "source_3", "source_4"]
