"""Language identification: bundles against their definition, held-out accuracy."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import langid, queries

SF = "/root/testdata/sf0.01"


def by_definition(letters, text):
    spaced = "".join(c if c.isalpha() else " " for c in f" {text} ")
    symbols = [ord(c.lower()[0]) if c != " " else 0 for c in " ".join(["", *spaced.split(), ""])]
    want = np.zeros(langid.DIMENSIONS)
    grams = Counter(zip(symbols, symbols[1:], symbols[2:])) if spaced.strip() else {}
    for gram, n in grams.items():
        bound = np.ones(langid.DIMENSIONS)
        for place, symbol in enumerate(gram):
            bound *= np.roll(letters.vector(symbol), 2 - place)
        want += n * bound
    return want


def bundled(letters, texts):
    out = np.zeros((len(texts), langid.DIMENSIONS))
    for first, vectors in letters.bundles(texts):
        out[first : first + len(vectors)] += vectors
    return out


@pytest.mark.parametrize("size, block", [(langid.SLICE, langid.BLOCK), (langid.SLICE, 5), (1, 2), (2, 3), (7, 4), (16, 2048)])
def test_bundles_by_definition(monkeypatch, size, block):
    monkeypatch.setattr(langid, "SLICE", size)
    monkeypatch.setattr(langid, "BLOCK", block)
    letters = langid.Letters()
    texts = ["Ab, ab!", "", "é", "123", "long word " * 50, "İx 日本", "a" + " " * 40 + "b", "seven77", " " * 21 + "x"]
    for text, vector in zip(texts, bundled(letters, texts)):
        assert (vector == by_definition(letters, text)).all(), text


def test_short_texts_in_bounded_memory():
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 25))) for _ in range(10_000)] + [""] * 10_000
    predict = langid.predictor({"zh": np.ones(langid.DIMENSIONS)}).func
    tracemalloc.start()
    (got,) = predict(iter([pd.Series(texts)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 20_000 and (got.lang_pred[10_000:] == "und").all() and peak < 300 << 20


def test_very_long_text_in_bounded_memory():
    text = "Quite some words, again and again. " * 200_000
    predict = langid.predictor({"en": np.ones(langid.DIMENSIONS)}).func
    tracemalloc.start()
    (got,) = predict(iter([pd.Series([text, "word"])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2 and peak < 200 << 20


def test_query_against_brute_force(spark):
    """Language and score of every document, by the definition of profiles and cosine."""
    sf = SF.replace("0.01", "0.001")
    got = queries.QUERIES["op2_language"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    letters, sums = langid.Letters(), {}
    vectors = {r.doc_id: by_definition(letters, r.text or "") for r in docs.itertuples()}
    for r in docs.itertuples():
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            sums[r.lang] = sums.get(r.lang, 0) + vectors[r.doc_id]
    assert len(got) == len(docs) == len(vectors)
    for i, v in vectors.items():
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()} if v.any() else {}
        best = max(sorted(cosines), key=cosines.get, default="und")
        assert got.lang_pred[i] == best
        assert got.score[i] == pytest.approx(min(1, max(0, cosines.get(best, 0))), abs=1e-9)


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !", "fr"), (4, "the the", "en"), (5, "le la", "fr"), (6, "le la", "fr"), (6, "le la", None), (None, "the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    predict = langid.predictor(langid.learn(docs))
    got = docs.select("doc_id", predict("text").alias("p")).collect()
    pred = {r.doc_id: r.p.lang_pred for r in got}
    assert pred == {1: "und", 2: "und", 3: "und", 4: "en", 5: "fr", 6: "fr", None: "en"}
    assert all(0 <= r.p.score <= 1 and (r.p.score > 0) == (r.p.lang_pred != "und") for r in got)


def test_nothing_learned_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    predict = langid.predictor(langid.learn(docs))
    assert docs.select(predict("text").alias("p")).first().p == ("und", 0.0)
    assert docs.limit(0).select(predict("text")).count() == 0


@pytest.fixture(scope="module")
def answers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc"))
    return queries.QUERIES["op2_language"](spark, SF).join(docs, "doc_id").toPandas()


def test_held_out_accuracy(answers):
    assert (answers.held_out == (answers.crc % 3 == 1)).all()
    held = answers[answers.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98
