"""The automaton against direct backoff formulas, and counts against brute force."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import lm, queries

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, None), (2, ""), (3, "a b a b a b a c"), (4, "A B\ta b\nc"), (4, "A B\ta b\nc"), (None, "a b zzz"), (5, "a b a b a c c"),
    (6, "é É a b"), (7, "a b " * 700), (8, "c c c a b a"), (9, "new words only"), (None, None), (10, "a\x0bb\x0ca\rb"),
]


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


class Model:
    """Backoff with absolute discounting, straight from the counts of all n-grams."""

    def __init__(self, texts, order, least=2):
        lists = [tokens(t) for t in texts]
        self.single = Counter(w for ws in lists for w in ws)
        self.total, self.order = sum(self.single.values()), order
        self.kept = {(w,): n for w, n in self.single.items() if n >= least}
        for k in range(2, order + 1):
            grams = Counter(tuple(ws[i : i + k]) for ws in lists for i in range(len(ws) - k + 1))
            self.kept |= {g: n for g, n in grams.items() if n >= least and g[:-1] in self.kept and g[1:] in self.kept}

    def p(self, word, context):
        while context and context not in self.kept:
            context = context[1:]
        if not context:
            return (self.single[word] + 0.1) / (self.total + 0.1 * (len(self.single) + 1))
        seen = {g[-1]: n for g, n in self.kept.items() if g[:-1] == context}
        if word in seen:
            return (seen[word] - 0.5) / self.kept[context]
        left = 1 - sum((n - 0.5) / self.kept[context] for n in seen.values())
        return max(left, 1e-12) / max(1 - sum(self.p(w, context[1:]) for w in seen), 1e-12) * self.p(word, context[1:])

    def score(self, text):
        words = tokens(text)
        return sum(math.log10(self.p(w, tuple(words[max(0, i - self.order + 1) : i]))) for i, w in enumerate(words))


def is_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


@pytest.mark.parametrize(("order", "least"), [(1, 2), (2, 2), (3, 2), (4, 2), (3, 1), (2, 3)])
def test_edge_rows(spark, order, least):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("batch", F.lit("x"))
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = lm.score_documents(docs, training, order=order, least=least).collect()
    model = Model([t for i, t in EDGE if is_training(i)], order, least)
    want = []
    for i, t in EDGE:
        words = tokens(t)
        base = sum(math.log10((model.single[w] + 0.1) / (model.total + 0.1 * (len(model.single) + 1))) for w in words)
        want.append((i, is_training(i), len(words), sum(w in model.single for w in words), model.total, base, model.score(t)))
    for g, w in zip(sorted(map(tuple, got), key=str), sorted(want, key=str), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_probabilities_sum_to_one():
    model = Model([t for _, t in EDGE], 3)
    for context in [(), ("a",), ("a", "b"), ("b", "a"), ("zzz",)]:
        unseen = (0.1 / (model.total + 0.1 * (len(model.single) + 1)), ()) if not context else None
        total = sum(model.p(w, context) for w in model.single) + (unseen[0] if unseen else model.p("never", context))
        assert total == pytest.approx(1)


def test_rare_ngrams_count_in_large_training(spark):
    # 1.6 million training tokens: a share of two millionths would ask for more than three occurrences.
    rows = [(i, "the same few words again and again " * 1_000) for i in range(230)]
    rows += [(1_000 + i, t) for i, t in enumerate(["rare pair here", "rare pair here", "once alone there", "rare pair there"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(docs, F.col("doc_id") != 1_003).collect()}
    model = Model([t for i, t in rows if i != 1_003], 3)
    assert got[0].train_tokens == model.total > 1_500_000
    for i, t in rows[-4:] + rows[:1]:
        assert got[i].score == pytest.approx(model.score(t))


def test_bounds_of_parameters(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for bad in ({"order": 0}, {"least": 0}):
        with pytest.raises(ValueError):
            lm.score_documents(docs, F.lit(True), **bad)


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score_documents(docs, F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.score == pytest.approx(row.base_score) == pytest.approx(0)
    assert lm.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_lm"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    single = Counter(w for i, t in docs.items() if is_training(i) for w in tokens(t))
    total = sum(single.values())
    held_score = held_base = 0
    for i, t in docs.items():
        words = tokens(t)
        base = sum(math.log10((single[w] + 0.1) / (total + 0.1 * (len(single) + 1))) for w in words)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not is_training(i), len(words), sum(w in single for w in words), total)
        assert r.base_score == pytest.approx(base)
        held_score, held_base = held_score + r.held_out * r.score, held_base + r.held_out * base
    assert len(got) == len(docs) and held_score > held_base
