import random

import pytest
from pyspark.sql import functions as F

from chunkloom.plans import lineage

NODE = "chunk_id string, source_id bigint, augmented_from string"


def walk(nodes, tip):
    """Status and entries by following one parent after another."""
    chain, current = [], tip
    while len(chain) < 32:
        if current in chain:
            return "cycle", chain
        chain.append(current)
        source, parent = nodes[current]
        if parent is None:
            return ("ok" if source is not None else "null_source"), chain
        if parent not in nodes:
            return "broken_parent", chain
        current = parent
    return "too_deep", chain


def compare(spark, nodes):
    df = spark.createDataFrame([(c, s, p) for c, (s, p) in nodes.items()], NODE)
    got = {r.chunk_id: r for r in lineage.chains(df).collect()}
    assert got.keys() == nodes.keys()
    for tip in nodes:
        status, chain = walk(nodes, tip)
        assert got[tip].status == status, (tip, status, got[tip])
        if status in ("ok", "null_source", "broken_parent", "too_deep"):
            assert got[tip].entries == chain
        if status == "ok":
            assert (got[tip].root_id, got[tip].root_source) == (chain[-1], nodes[chain[-1]][0])
    return got


def chain_of(prefix, n, root_parent=None, source=7):
    nodes = {f"{prefix}{i}": (source, f"{prefix}{i - 1}") for i in range(1, n)}
    return {f"{prefix}0": (source, root_parent), **nodes}


def test_boundaries(spark):
    nodes = {**chain_of("a", 1), **chain_of("b", 3), **chain_of("c", 32), **chain_of("d", 33), **chain_of("e", 70),
             **chain_of("f", 34, "gone"), **chain_of("g", 5, source=None), "self": (1, "self")}
    for n in (2, 31, 32, 33):
        nodes.update({f"cy{n}_{i}": (1, f"cy{n}_{(i + 1) % n}") for i in range(n)})
        nodes[f"tail{n}"] = (1, f"cy{n}_0")
    got = compare(spark, nodes)
    want = {"a0": "ok", "c31": "ok", "d32": "too_deep", "d31": "ok", "e69": "too_deep", "f31": "broken_parent",
            "f32": "too_deep", "g4": "null_source", "self": "cycle", "cy31_0": "cycle", "cy32_0": "too_deep", "cy33_0": "too_deep"}
    assert {k: got[k].status for k in want} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = {}
    for i in range(150):
        parent = rng.choice([None, f"n{rng.randrange(150)}", f"n{max(0, i - 1)}", f"n{max(0, i - 1)}", "gone"])
        nodes[f"n{i}"] = (rng.choice([None, 1, 2, 3]), parent)
    compare(spark, nodes)


def test_resolution_and_broken_parents(spark):
    df = spark.createDataFrame([("a", 1, None), ("a_x", 1, "a"), ("b", 2, None), ("c", 3, "no")], NODE)
    sources = spark.createDataFrame([(1,), (3,)], "id bigint")
    variants = spark.createDataFrame([(10, 1, False), (11, 1, True)], "id bigint, source_id bigint, is_canonical boolean")
    found = {r.chunk_id: r for r in lineage.resolve(lineage.chains(df), sources, variants).collect()}
    assert (found["a_x"].status, found["a_x"].source_id, found["a_x"].variant_id) == ("ok", 1, 11)
    assert found["b"].status == "source_missing" and found["c"].status == "broken_parent"
    assert [r.chunk_id for r in lineage.broken_parents(df).collect()] == ["c"]
    entries = lineage.chain_entries(lineage.chains(df)).where(F.col("chunk_id") == "a_x").orderBy("depth")
    assert [(r.depth, r.entry_id) for r in entries.collect()] == [(1, "a_x"), (2, "a")]
