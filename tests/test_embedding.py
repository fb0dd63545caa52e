"""Feature hashing against a dictionary of counts."""

import glob
import hashlib
import math
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chunkloom.operators.assets import run_tagger
from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.operators.embedding import tag_embeddings
from chunkloom.sources.chunk_table import ChunkTable

TEXTS = ["a b a b c", "The the THE", None, "", "  \n ", "one", "a b a b c", "x " * 3000, "é ü 中文 é"]


def expected(texts, width):
    counts = []
    for t in texts:
        w = (t or "").lower().split()
        counts.append(Counter(hashlib.md5(f.encode()).hexdigest() for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]))
    spread = Counter(d for c in counts for d in c)
    out = []
    for c in counts:
        v = [0.0] * width
        for d, n in c.items():
            weight = (1 + math.log(n)) * (1 + math.log((len(texts) + 1) / (spread[d] + 1)))
            v[int(d[:12], 16) % width] += weight * (1 if int(d[12], 16) % 2 == 0 else -1)
        length = math.sqrt(sum(x * x for x in v))
        out.append([x / length for x in v] if length > 0 else None)
    return out


@pytest.mark.parametrize("width", [1024, 7])
def test_vectors(spark, width):
    rows = [(f"{i}_0", t) for i, t in enumerate(TEXTS)]
    got = {r.chunk_id: r.attr_embed_vector for r in tag_embeddings(spark.createDataFrame(rows, "chunk_id string, text string"), width).collect()}
    for i, want in enumerate(expected(TEXTS, width)):
        assert (got[f"{i}_0"] is None) == (want is None)
        if want:
            assert got[f"{i}_0"] == pytest.approx(want, abs=1e-6)
            assert math.sqrt(sum(x * x for x in got[f"{i}_0"])) == pytest.approx(1, abs=1e-5)
    assert got["0_0"] == got["6_0"]


def test_empty_table_and_tagger(spark, folder):
    assert tag_embeddings(spark.createDataFrame([], "chunk_id string, text string")).collect() == []
    table = ChunkTable(spark, folder, buckets=2)
    docs = spark.createDataFrame([(1, 1, "some words"), (2, 1, "others")], "source_id long, source_collection_id long, text string")
    table.replace_rows(fixed_size_chunks(docs))
    run_tagger(table, "attr_embed")
    assert {r.n for r in table.read().select(F.size("attr_embed_vector").alias("n")).collect()} == {1024}


def test_features_are_asked_for_once_a_batch(spark, monkeypatch):
    from chunkloom.operators import embedding

    monkeypatch.setattr(embedding, "BATCH_TEXTS", 3)
    rows = [(f"{i}_0", t) for i, t in enumerate(TEXTS * 9)]
    vectors = tag_embeddings(spark.createDataFrame(rows, "chunk_id string, text string"), 64)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    # Neither a row for each feature of a text nor a vector is shuffled.
    assert "Generate" not in plan and "Join" not in plan
    got = {r.chunk_id: r.attr_embed_vector for r in vectors.collect()}
    want = expected(TEXTS * 9, 64)
    assert len(got) == len(want)
    for i, vector in enumerate(want):
        assert got[f"{i}_0"] == (vector and pytest.approx(vector, abs=1e-6))


def test_batches_are_scanned_a_few_at_a_time(spark, monkeypatch):
    from chunkloom.operators import embedding

    written, materialize = [], embedding.materialize
    monkeypatch.setattr(embedding, "materialize", lambda *a, **b: written.append(materialize(*a, **b)) or written[-1])
    monkeypatch.setattr(embedding, "BATCH_BYTES", 1 << 14)
    monkeypatch.setattr(embedding, "GROUP_BYTES", 1 << 16, raising=False)
    # The first batches are small ones, which say nothing of those behind them.
    monkeypatch.setattr(embedding, "BATCH_TEXTS", 8)
    texts = [f"{i}" for i in range(64)] + [" ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest() for j in range(60)) for i in range(600)]
    chunks = spark.createDataFrame([(f"{i}_0", t) for i, t in enumerate(texts)], "chunk_id string, text string").coalesce(1)
    assert tag_embeddings(chunks, 64).count() == len(texts)
    (file,) = glob.glob(f"{written[0].scratch_path.removeprefix('file:')}/*.parquet")
    groups = pq.ParquetFile(file).metadata
    sizes = [groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)]
    assert sum(sizes) > 1 << 20 and max(sizes) <= (1 << 16) + 3 * (1 << 14)
