"""Positive-unlabelled quality: gradient of the risk, held-out accuracy, edge rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import pu_quality, queries

SF = "/root/testdata/sf0.1"


def made(rng, n, share):
    """n rows, ``share`` of them positive, and which."""
    positive = rng.random(n) < share
    return rng.normal(np.where(positive, 1.5, -1.5)[:, None], 1, (n, 3)), positive


def local_fit(x, marks, prior=None):
    """The whole fit in memory, without Spark."""
    net = pu_quality.Network(x.mean(axis=0), x.std(axis=0) + 1e-9)

    def sums_at(weights):
        return net.terms(x, marks, weights)

    if prior is None:
        net.weights = pu_quality.minimise(sums_at, net.weights, pu_quality.FIRST_PRIOR, pu_quality.FIRST_STEPS)
        place = ((np.clip(net.inputs(x) @ net.weights, -10, 9.99) + 10) * (pu_quality.BINS / 20)).astype(int)
        prior = pu_quality.class_prior(np.bincount(place, minlength=pu_quality.BINS), np.bincount(place, marks, pu_quality.BINS))
        net.weights = net.weights * 0
    net.weights = pu_quality.minimise(sums_at, net.weights, prior, pu_quality.STEPS)
    net.prior = prior
    return net


def test_slope_and_curvature_of_the_risk():
    rng = np.random.default_rng(1)
    x, positive = made(rng, 200, 0.4)
    marks = (positive & (rng.random(200) < 0.5)) * 1.0
    net, prior = pu_quality.Network(x.mean(axis=0), x.std(axis=0)), 0.4

    def by_definition(w):
        score = net.inputs(x) @ w
        p = marks / marks.sum()
        negative = np.logaddexp(0, score).mean() - prior * p @ np.logaddexp(0, score)
        return prior * p @ np.logaddexp(0, -score), negative

    for w in (np.zeros(len(net.weights)), rng.normal(size=len(net.weights))):
        risk = pu_quality.Risk(net.terms(x, marks, w), w, prior)
        assert (risk.positive, risk.negative) == pytest.approx(by_definition(w))
        for i in range(0, len(w), 5):
            step = np.zeros(len(w))
            step[i] = 1e-5
            up, down = (pu_quality.Risk(net.terms(x, marks, w + d), w + d, prior) for d in (step, -step))
            assert risk.slope[i] == pytest.approx((up.value - down.value) / 2e-5, abs=1e-6)
            assert risk.curvature[i] == pytest.approx((up.slope - down.slope) / 2e-5, abs=1e-5)


def test_negatives_risk_stays_above_zero():
    rng = np.random.default_rng(5)
    x, positive = made(rng, 60, 0.5)
    # Far too large a prior: unbounded, the negatives' risk would fall below zero.
    net = local_fit(x, positive * 1.0, prior=0.95)
    assert pu_quality.Risk(net.terms(x, positive * 1.0, net.weights), net.weights, 0.95).negative >= 0


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 0.9])
def test_prior_from_positives_only(spark, share):
    rng = np.random.default_rng(int(share * 10))
    x, positive = made(rng, 20_000, share)
    known = positive & (rng.random(len(x)) < 0.3)
    stats = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(int(i), 1) for i in np.flatnonzero(known)], "doc_id long, quality int")
    scores = pu_quality.fit(stats, labels)
    assert scores.__self__.prior == pytest.approx(share, abs=0.05)
    assert ((scores(x) >= 0.5) == positive).mean() > 0.97
    # The same sums over all rows in memory.
    assert scores(x) == pytest.approx(local_fit(x, known * 1.0).scores(x), abs=1e-4)


def test_statistics_do_not_depend_on_the_neighbours():
    texts = ["One two two.\nOne two two.\n", None, "", "A|B 12", " \n ", "é" * 10, "end\n", "\nstart"]
    whole = pu_quality.style(pa.array(texts))
    alone = np.concatenate([pu_quality.style(pa.array([t])) for t in texts])
    assert np.isfinite(whole).all() and np.allclose(whole, alone)
    assert not whole[[1, 2, 4]].any()


@pytest.mark.parametrize("marks", [[(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, 0)], [(1, 1, 0)], [(2, 0, 0)], []])
def test_edge_rows(spark, marks):
    rows = [(1, "good text here."), (2, "| | |"), (3, None), (4, ""), (4, ""), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(9)).withColumn("x", F.lit(9))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = pu_quality.score_documents(docs, labels, F.lit(True)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pu_quality.score_documents(docs, labels, F.lit(True)).count() == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.QUERIES["op4_quality"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert len(scored) > 500 and (scored.predicted == scored.quality).mean() > 0.97
    assert scored.score[scored.quality == 0].mean() < 0.1


def test_query_against_the_fit_in_memory(spark):
    """Every score of the query, from statistics and labels gathered here and fitted without Spark."""
    sf = SF.replace("0.1", "0.01")
    got = queries.QUERIES["op4_quality"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    x = pu_quality.style(pa.array(docs.text))
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in docs.doc_id])
    marks = np.array([float(i in good) for i in docs.doc_id])
    net = local_fit(x[train], marks[train])
    assert (got.held_out[docs.doc_id] == ~train).all()
    assert got.score[docs.doc_id].to_numpy() == pytest.approx(net.scores(x), abs=1e-4)


def test_moments_of_all_rows_and_rows_without_id(spark):
    stats = spark.range(4_000).selectExpr("IF(id < 2000, id, NULL) AS doc_id", "array(double(id), double(id % 7)) AS x")
    labels = spark.range(0, 2_000, 2).selectExpr("id AS doc_id", "1 AS quality")
    network = pu_quality.fit(stats, labels.union(labels.limit(5))).__self__
    x = np.array([[i, i % 7] for i in range(4_000)], float)
    assert network.mean == pytest.approx(x.mean(axis=0)) and network.scale == pytest.approx(x.std(axis=0))


def test_equal_rows_count_as_often_as_they_occur(spark):
    # A third of all rows is one row, without an id.
    rows = [(i, [float(i % 10), 1.0]) for i in range(200)] + [(None, [3.0, 9.0])] * 100
    stats = spark.createDataFrame(rows, "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    x, marks = np.array([r[1] for r in rows]), np.array([float(i is not None and i % 2 == 0) for i, _ in rows])
    assert pu_quality.fit(stats, labels, prior=0.4)(x) == pytest.approx(local_fit(x, marks, 0.4).scores(x), abs=1e-4)


def test_very_long_text(spark):
    long = "A plain sentence, as long as it is. " * 100_000
    got = pu_quality.style(pa.array([long, "short one."]))
    assert got[0, 1] == pytest.approx(np.log1p(800_000)) and np.isfinite(got).all()
