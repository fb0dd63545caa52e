"""SimHash against brute force over all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from chunkloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Lowest label reachable, by repeated passes over all close pairs."""
    label = {p: p for p in prints}
    pairs = [(a, b) for a in label for b in label if a < b and bin(a ^ b).count("1") <= 3]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def expected(rows):
    prints = {}
    for i, text in rows:
        prints.setdefault(brute_fingerprint(text), []).append(i)
    label, first = brute_components(prints), {}
    for p, ids in prints.items():
        known = [i for i in ids if i is not None]
        first[label[p]] = min([*known, *([first[label[p]]] if first.get(label[p]) is not None else [])], default=None)
    return sorted(
        ((i, f"{p:016x}", first[label[p]]) for p, ids in prints.items() for i in ids), key=str
    )


EDGE = [
    (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (4, "one TWO"), (None, "one two"), (None, None),
    (5, "ÀÉ à"), (6, "Àé à"), (7, "word " * 5000), (8, "word " * 5001), (9, "one"), (None, "lonely words of none"),
]


def test_edge_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2))
    got = sorted(map(tuple, simhash.near_duplicates(rows).collect()), key=str)
    assert got == expected(EDGE)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.QUERIES["op7_simhash"](spark, SF).collect()), key=str)
    assert got == expected(map(tuple, docs))


@pytest.mark.parametrize("limit", [2, 20, 2048])
def test_hot_buckets_give_the_same_components(spark, limit):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        x = centre
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    df = spark.createDataFrame([(s, s) for s in signed], "doc_id long, fp long")
    got = {signed[r.fp]: r.root for r in simhash.components(df, limit).collect()}
    want = brute_components(prints)
    assert len(set(want.values())) > 2
    groups = {}
    for p, root in got.items():
        groups.setdefault(root, set()).add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_one_of_each_group_stays(spark):
    rows = spark.createDataFrame(EDGE + [(4, "one TWO")], "doc_id long, text string").withColumn("lang", F.lit("x"))
    kept = simhash.first_of_groups(rows)
    assert kept.columns == ["doc_id", "text", "lang"]
    ids = [(c, {i for i, _, d in expected(EDGE) if c == d}) for c in {d for _, _, d in expected(EDGE)}]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c, _ in ids)


def test_first_of_groups_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "other text here")], "doc_id long, text string")
    docs = docs.withColumns({"_best_id": F.lit(1), "_BEST_BODY": F.lit("x"), "fp": F.lit(2), "root": F.lit("r")})
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
