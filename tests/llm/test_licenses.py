"""License scans: base places by direct search, further labels by example."""

import re

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import licenses, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
APACHE = next(t for t in licenses.NOTICES if "apache" in t)
EDGE = [
    (1, None), (2, ""), (3, "cc by"), (4, "CC-BY-NC"), (5, "Under the MIT License under the mit license, CC BY NC"), (5, "Under the MIT License under the mit license, CC BY NC"),
    (None, "Apache License, Version 2.0"), (6, "cc by ncé"), (7, "under the mıt license"), (8, "under the mit Kicense"), (9, "x " * 4000 + "cc by nc " * 50),
    (10, APACHE), (11, APACHE.replace("file except", "very own file just except")), (12, "the license you may"), (13, "apache license version 2 cc by nc 2"),
]


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(rows, got):
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(((r.doc_id, *(r[c] for c in columns)) for r in got), key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))


def test_edge_rows(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("places", F.lit(1))
    got = licenses.scan(docs).collect()
    check(EDGE, got)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[10] == labels[11] == "apache-2"
    assert labels[12] == labels[1] == labels[3] == labels[8] == ""


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_direct_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(list(map(tuple, docs)), queries.QUERIES["op10_licenses"](spark, SF).collect())


@pytest.mark.parametrize("text", [*licenses.PHRASES, *licenses.NOTICES])
def test_templates_have_enough_words(text):
    assert len(text.split()) >= licenses.K and text == " ".join(WORD.findall(text))
