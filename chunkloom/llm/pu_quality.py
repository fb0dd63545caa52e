"""Quality by positive-unlabelled learning.

A layer of fixed random units over style statistics of whole texts feeds one fitted
layer.  It minimises the non-negative unbiased risk: with trusted positives P, unlabelled
web texts U and the class prior p, the risk of negatives is R_U(-) - p R_P(-), which no true
risk makes negative; a step that takes it below zero goes back.  With the logistic loss
the unbiased risk is convex, so few second-order steps do, and the score estimates the
probability of label 1.

The prior is estimated: U holds p of P, so in any set of texts the share of U is at least
p times that of P.  The sets are those above a score of a first fit, and the estimate is the
least ratio of the two shares.

The statistics are computed once, in the tasks that scan the texts, and kept in a
narrow table.  Nothing is sampled: each step sums the risk, its slope and its curvature over
all rows within tasks, and only these sums, whose number does not depend on the rows, reach
the driver.

Null and empty texts have statistics of zero and get the score these get; texts of any
length are read whole.  Equal statistics get equal scores.  Repeated rows count and are
returned as often as they occur.  Without any positive label every score is ``PRIOR``.  Rows of
``labels`` with null id or quality, and negative labels, teach nothing.  An empty table gives an
empty one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from chunkloom.llm.common import byte_slices, span_hashes, text_bytes, word_spans
from chunkloom.session import materialize

HIDDEN = 24
# Steps of the first fit and of the fit with the estimated prior, at most.
FIRST_STEPS = 6
STEPS = 12
RIDGE = 1e-4
# The prior of the first fit: small, so that its scores stay in proportion to the ratio P/U.
FIRST_PRIOR = 0.05
# Sets that hold less than this share of P are too small to tell the prior.
LEAST_SHARE = 0.2
BINS = 1000
# The score where there is no positive label.
PRIOR = 0.5
THRESHOLD = 0.3


def style(texts):
    """Statistics of texts (an Arrow array), one row each."""
    import numpy as np

    n = len(texts)
    data, offsets = text_bytes(texts, lower=False)
    size = np.diff(offsets)

    def share(flags, total=size):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(total, 1)

    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    starts, ends, rows = word_spans(data, offsets, ~blank)
    words = np.bincount(rows, minlength=n)
    per_word = np.maximum(words, 1)

    def mean(values):
        return np.bincount(rows, weights=values, minlength=n) / per_word

    length = ends - starts
    hashes = span_hashes(data, starts, ends)
    same = np.zeros(len(rows), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((hashes, rows))
    first = np.ones(len(rows), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    runs, run_rows = np.diff(np.append(np.flatnonzero(first), len(rows))), rows[order][first]
    most = np.zeros(n)
    np.maximum.at(most, run_rows, runs)
    lines_at, lines_end, line_rows = word_spans(data, offsets, np.arange(256) != 10)
    lines = np.bincount(line_rows, minlength=n)
    line_hash = span_hashes(data, lines_at, lines_end)
    order = np.lexsort((line_hash, line_rows))
    again = (line_hash[order][1:] == line_hash[order][:-1]) & (line_rows[order][1:] == line_rows[order][:-1])
    repeated_lines = np.bincount(line_rows[order][1:][again], minlength=n)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    last = data[ends - 1] if len(ends) else data[:0]
    columns = [
        np.log1p(size),
        np.log1p(words),
        np.log1p(lines),
        mean(length),
        mean(length <= 3),
        mean(length >= 10),
        mean((last == 46) | (last == 33) | (last == 63)),
        mean(last == 44),
        mean(same),
        np.bincount(run_rows, minlength=n) / per_word,
        most / per_word,
        repeated_lines / np.maximum(lines, 1),
        share(upper),
        share(digit),
        share(~letter & ~digit & ~blank[data]),
        share(data == 124),
        share(data >= 128),
        mean(upper[starts] if len(starts) else length),
        share(data == 10),
        words / np.maximum(lines, 1),
    ]
    return np.where((words > 0)[:, None], np.stack(columns, axis=1), 0.0)



def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The statistics of each text of a column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for texts in batches:
        column = pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), "")
        out = []
        for a, b in byte_slices(pc.binary_length(column).to_pylist()):
            out += list(style(column.slice(a, b - a)))
        yield pd.Series(out, dtype=object)


statistics = F.pandas_udf(_statistics, ArrayType(DoubleType()))


class Network:
    """Fixed random units and one fitted layer over standardised statistics."""

    def __init__(self, mean, scale):
        import numpy as np

        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(0)
        self.inner = rng.normal(0, len(mean) ** -0.5, (len(mean), HIDDEN)), rng.normal(0, 1, HIDDEN)
        self.weights = np.zeros(1 + len(mean) + HIDDEN)

    def inputs(self, x):
        """What the fitted layer sees: one, the statistics, the units."""
        import numpy as np

        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, np.tanh(z @ self.inner[0] + self.inner[1])], axis=1)

    def terms(self, x, marks, weights):
        """Sums over rows for ``Sums``: U's and P's part of the risk, its slope and curvature.

        ``marks`` says how often a row is a trusted positive."""
        import numpy as np

        f = self.inputs(x)
        score = f @ weights
        loss, slope = np.logaddexp(0, score), sigmoid(score)
        return np.concatenate(
            [
                [len(x), marks.sum(), loss.sum(), marks @ loss],
                marks @ f,
                slope @ f,
                ((slope * (1 - slope))[:, None] * f).T.dot(f).ravel(),
            ]
        )

    def scores(self, x):
        return sigmoid(self.inputs(x) @ self.weights)


class Risk:
    """The risk at one point, from the sums of ``Network.terms``."""

    def __init__(self, sums, weights, prior: float):
        n, marked, loss_u, loss_p = sums[:4]
        width = len(weights)
        mean_p, slope_u = sums[4 : 4 + width] / marked, sums[4 + width : 4 + 2 * width] / n
        # Of the negatives: U's loss as negatives without P's share in it.
        self.negative = loss_u / n - prior * loss_p / marked
        # The loss as a positive is the loss as a negative less the score.
        self.positive = prior * (loss_p / marked - weights @ mean_p)
        self.value = self.positive + self.negative + RIDGE / 2 * weights @ weights
        self.slope = slope_u - prior * mean_p + RIDGE * weights
        self.curvature = sums[4 + 2 * width :].reshape(width, width) / n
        self.curvature[range(width), range(width)] += RIDGE


def minimise(sums_at, weights, prior: float, steps: int):
    """Second-order steps down the risk; one that does not lower it, or takes the
    negatives' risk below zero, is halved, and at last undone."""
    import numpy as np

    at = Risk(sums_at(weights), weights, prior)
    for _ in range(steps):
        step, share = np.linalg.solve(at.curvature, at.slope), 1.0
        if step @ at.slope < 1e-5:
            break
        while share > 0.05:
            there = weights - share * step
            risk = Risk(sums_at(there), there, prior)
            if risk.value < at.value and risk.negative >= 0:
                weights, at = there, risk
                break
            share /= 2
        else:
            break
    return weights


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def moments(stats: DataFrame):
    """Mean and scale of each statistic over all rows."""
    found = stats.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    found = found.toPandas().sort_values("i")
    return found["mean"].to_numpy(), found["scale"].to_numpy() + 1e-9


def _row_sums(terms):
    """A function for ``mapInArrow``: rows (x, marks) -> the sum of ``terms(x, marks)``, a row for each number."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            total = total + terms(x, batch.column("marks").to_numpy())
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    return run


def summed(rows: DataFrame, terms):
    """The sum of ``terms`` over all rows (x, marks), as an array."""
    found = rows.select("x", F.col("marks").cast("double")).mapInArrow(_row_sums(terms), "i int, x double")
    return found.groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()


def class_prior(unlabelled, positives) -> float:
    """The least ratio of U's share to P's above a score, from two histograms of scores.

    One standard error is left on both shares, as the least of many noisy ratios is too small."""
    import numpy as np

    n, m = unlabelled.sum(), positives.sum()
    u, p = np.cumsum(unlabelled[::-1]) / n, np.cumsum(positives[::-1]) / m
    high, low = u + np.sqrt(u * (1 - u) / n), p - np.sqrt(p * (1 - p) / m)
    enough = (p >= LEAST_SHARE) & (low > 0)
    return float(np.clip((high[enough] / low[enough]).min(), 0.01, 0.99))


def estimated_prior(rows: DataFrame, network: Network) -> float:
    """The prior by the scores of ``network`` over all rows."""
    import numpy as np

    def bins(x, marks):
        # By the odds, so that small scores differ too.
        at = np.clip(network.inputs(x) @ network.weights, -10, 9.99)
        place = ((at + 10) * (BINS / 20)).astype(int)
        return np.concatenate([np.bincount(place, minlength=BINS).astype(float), np.bincount(place, marks, BINS)])

    found = summed(rows, bins)
    return class_prior(found[:BINS], found[BINS:])


def fit(stats: DataFrame, labels: DataFrame, prior: float | None = None):
    """``stats(doc_id, x)`` of training texts and ``labels(doc_id, quality)`` -> a function
    from a matrix of statistics to scores; ``prior`` is estimated unless given."""
    import numpy as np

    marks = labels.where("CAST(quality AS int) = 1 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("marks"))
    marked = stats.select("doc_id", "x").join(marks, "doc_id", "left")
    rows = materialize(marked.select("x", F.coalesce("marks", F.lit(0)).alias("marks")), "marked")
    if rows.where("marks > 0").isEmpty():
        return lambda x: np.full(len(x), PRIOR if prior is None else prior)
    network = Network(*moments(rows))

    def sums_at(weights):
        return summed(rows, lambda x, marks: network.terms(x, marks, weights))

    if prior is None:
        network.weights = minimise(sums_at, network.weights, FIRST_PRIOR, FIRST_STEPS)
        prior = estimated_prior(rows, network)
        network.weights = network.weights * 0
    network.weights = minimise(sums_at, network.weights, prior, STEPS)
    network.prior = prior
    return network.scores


def scorer(scores):
    """A function of the column of statistics: the score."""

    @F.pandas_udf(DoubleType())
    def score(stats: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(scores(np.stack(stats))) if len(stats) else pd.Series([], dtype=float)

    return score


def _statistics_table(docs: DataFrame, training: Column, id_column: str, text_column: str) -> DataFrame:
    columns = F.col(id_column).alias("doc_id"), training.alias("training"), statistics(F.col(text_column)).alias("x")
    return materialize(docs.select(*columns), "statistics")


def text_scorer(scores):
    """A function of the column of texts: the score, by one Python worker for each task."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for stats in _statistics(batches):
            yield pd.Series(scores(np.stack(stats)) if len(stats) else [], dtype=float)

    return score


def learn(docs: DataFrame, labels: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text"):
    """A function of the column of texts, fitted to the rows of ``docs`` where ``training``."""
    return text_scorer(fit(_statistics_table(docs.where(training), training, id_column, text_column), labels))


def score_documents(
    docs: DataFrame, labels: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, training (as given), score, predicted.

    ``training`` says of a row of ``docs`` whether its label may be learned.
    """
    stats = _statistics_table(docs, training, id_column, text_column)
    score = scorer(fit(stats.where("training"), labels))
    return stats.select("doc_id", "training", score("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
