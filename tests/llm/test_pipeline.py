"""The pipeline's stages against their operators, and its contract."""

import base64
import random
import string

import pytest

import corpus_pipeline
from chunkloom.llm import decontam, langid, queries
from test_near_texts import first_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage got and left."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out.append((name, docs, left))
        docs = left
    return out


def test_all_but_the_last_return_documents(steps):
    for name, docs, left in steps[:-1]:
        assert left.schema == docs.schema, name
        assert left.subtract(docs).isEmpty() and left.count() <= docs.count(), name
    assert steps[-1][2].select("doc_id").distinct().count() == steps[-1][1].count()


def test_quality_stage_keeps_the_good_and_rejects_the_bad(spark):
    larger = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality(spark, docs, larger).join(labels, "doc_id").groupBy("quality").count().collect()
    counts = {r.quality: r["count"] for r in kept}
    total = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert counts.get(1, 0) >= 0.97 * total[1] and counts.get(0, 0) <= 0.1 * total[0]


def test_language_stage_keeps_all_prose(steps):
    _, docs, left = steps[1]
    assert left.count() >= 0.99 * docs.count()


def test_language_stage_rejects_what_is_no_learned_language(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    rng, first = random.Random(3), 10_000_000
    noise = [base64.b64encode(rng.randbytes(2_250)).decode() for _ in range(30)]
    noise += [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(500)) for _ in range(30)]
    noise += ["\n".join(rng.randbytes(32).hex() for _ in range(47)) for _ in range(30)]
    noise += ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3_000)) for _ in range(30)]
    noise += [" ".join("".join(chr(rng.randint(0x430, 0x44F)) for _ in range(6)) for _ in range(500)) for _ in range(30)]
    texts = [r.text.split() for r in docs.where("length(text) > 300").orderBy("doc_id").limit(100).collect()]
    short = [" ".join(words[:10]) for words in texts]
    made = spark.createDataFrame([(first + i, t, None) for i, t in enumerate(noise + short)], docs.schema)
    kept = [r.doc_id - first for r in corpus_pipeline.language(spark, docs.union(made), SF).where(f"doc_id >= {first}").collect()]
    assert sum(i < len(noise) for i in kept) == 0
    assert sum(i >= len(noise) for i in kept) >= 0.95 * len(short)


def test_near_duplicates_keep_the_smallest_of_each_group(steps):
    _, docs, left = steps[2]
    want, _ = first_ids(docs.select("doc_id", "text").collect())
    assert {r.doc_id for r in left.select("doc_id").collect()} == want


def test_decontamination_removes_just_the_hit_documents(spark, steps):
    _, docs, left = steps[3]
    report = decontam.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    clean = report.where("NOT contaminated").select("doc_id").collect()
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(r.doc_id for r in clean)
    assert left.count() < docs.count()


def test_run_equals_the_stages(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = queries.QUERIES["pipeline"](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps[-1][2].select(*columns).collect()))


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0, name


def test_undecided_language_is_named():
    assert langid.UNKNOWN == "und" and corpus_pipeline.LEAST_COSINE < 0.1
