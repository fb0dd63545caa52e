import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import minhash
from chunkloom.plans.components import connected_components
from chunkloom.plans.ranking import previous_in_group, rank_in_group

ROW = "chunk_id string, source_id bigint, text string"


def naive_signature(text):
    mult, off = minhash.permutations()
    w = (text or "").lower().split()
    grams = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
    hashes = [int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams]
    return [
        min([((int(a) * h + int(b)) % 2**64 % (2**61 - 1)) & 0xFFFFFFFF for h in hashes], default=2**32 - 1)
        for a, b in zip(mult, off)
    ]


def naive_clusters(rows):
    """{(source, chunk): (label, head?)} by comparing all pairs."""
    out = {}
    for source in {r[1] for r in rows}:
        own = sorted((r[0], naive_signature(r[2])) for r in rows if r[1] == source)
        root = {c: c for c, _ in own}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for (c1, s1), (c2, s2) in combinations(own, 2):
            if any(s1[b : b + 16] == s2[b : b + 16] for b in range(0, 128, 16)):
                a, b = sorted((find(c1), find(c2)))
                root[b] = a
        heads = sorted({find(c) for c, _ in own})
        for c, _ in own:
            out[c] = (heads.index(find(c)), find(c) == c)
    return out


def near_copies(n, sources, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 30])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((f"{i % sources}_{i}", i % sources, " ".join(words)))
    return rows + [("0_short1", 0, "a b"), ("0_short2", 0, ""), ("0_short3", 0, None), ("1_short", 1, " ")]


def tagged(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    return {r.chunk_id: r for r in minhash.tag_near_duplicates(df).collect()}


def test_signatures_equal_the_definition(spark):
    texts = ["The quick brown fox jumps", "a b", "", None, "Same same same same", " ".join(f"w{i}" for i in range(1500))]
    df = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], ROW)
    got = {r.chunk_id: list(r.attr_minhash_signature) for r in minhash.signatures(df).collect()}
    for i, text in enumerate(texts):
        assert got[str(i)] == naive_signature(text)
    assert got["1"] == got["2"] == got["3"] == [2**32 - 1] * 128


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_all_pairs(spark, seed):
    rows = near_copies(120, 2, seed)
    got = tagged(spark, rows)
    want = naive_clusters(rows)
    assert {c: (r.attr_minhash_cluster_id, r.attr_minhash_is_head) for c, r in got.items()} == want
    assert 2 < len({v[0] for v in want.values()}) < 120


def test_labels_do_not_depend_on_order(spark):
    rows = near_copies(40, 1, 5)
    shuffled = random.Random(0).sample(rows, len(rows))
    labels = lambda found: {c: r.attr_minhash_cluster_id for c, r in found.items()}
    assert labels(tagged(spark, rows)) == labels(tagged(spark, shuffled))


def test_copies_share_the_smallest_head_within_a_source(spark):
    text = "one two three four five"
    got = tagged(spark, [("c2", 1, text), ("c1", 1, text), ("c3", 1, "six seven eight nine"), ("d1", 2, text)])
    assert [(got[c].attr_minhash_cluster_id, got[c].attr_minhash_is_head) for c in ("c1", "c2", "c3", "d1")] == [
        (0, True), (0, False), (1, True), (0, True)]


def test_empty_input(spark):
    assert tagged(spark, [("c", 1, "x")]).keys() == {"c"}
    assert minhash.tag_near_duplicates(spark.createDataFrame([], ROW)).count() == 0


@pytest.mark.parametrize("shape", ["path", "random", "star", "cycle"])
def test_components(spark, shape):
    rng = random.Random(3)
    name = lambda i: f"n{i:03d}"
    pairs = {
        "path": [(i, i + 1) for i in range(0, 60)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "star": [(0, i) for i in range(1, 50)] + [(60, i) for i in range(61, 70)],
        "cycle": [(i, (i * 7 + 3) % 41) for i in range(41)],
    }[shape]
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "hi string, lo string")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {name(n): name(r) for n, r in root.items() if n != r}


def test_rank_and_previous_in_a_hot_group(spark):
    rng = random.Random(9)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 5), i, f"v{rng.randrange(3)}") for i in range(800)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, o int, v string")
    got = {(r.k, r.o): r.pos for r in rank_in_group(df, ["k"], ["o"], "pos", parts=7).collect()}
    before = {(r.k, r.o): r.prev for r in previous_in_group(df, "k", ["o"], "v", "prev", parts=7).collect()}
    for k in range(5):
        own = sorted((o, v) for kk, o, v in rows if kk == k)
        for i, (o, _) in enumerate(own):
            assert got[(k, o)] == i
            assert before[(k, o)] == (own[i - 1][1] if i else None)
    parts = rank_in_group(df, ["k"], ["o"], "pos", parts=7)
    assert parts.where("k = 0").agg(F.max("pos")).first()[0] == sum(r[0] == 0 for r in rows) - 1
