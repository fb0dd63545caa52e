"""Near copies against an exact search for pairs of texts."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import near_texts, simhash

SF = "/root/testdata/sf0.1"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_pairs(texts):
    """All pairs with a similarity of 0.8: each shares one of its rarest shingles."""
    sets = [shingles(t) for t in texts]
    counts = Counter(s for one in sets for s in one)
    index, out = defaultdict(list), set()
    for i, one in enumerate(sets):
        rare = sorted(one, key=lambda s: (counts[s], s))[: len(one) - math.ceil(0.8 * len(one) - 1e-9) + 1]
        for j in {j for s in rare for j in index[s]}:
            both = len(one & sets[j])
            if both >= 0.8 * (len(one) + len(sets[j]) - both) - 1e-9:
                out.add((j, i))
        for s in rare:
            index[s].append(i)
    return out


def first_ids(rows):
    """The ids an exact search leaves, and how many it removes beyond equal texts."""
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[b" ".join(words(text))].append(doc_id)
    texts, ids = [t.decode() for t in classes], [min(v) for v in classes.values()]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in similar_pairs(texts):
        a, b = root(a), root(b)
        parent[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    left = {ids[root(i)] for i in range(len(ids))}
    return left, len(ids) - len(left)


def made_texts(seed, bases, copies, edits):
    """Random texts with copies in which a few words are replaced."""
    rng, out = random.Random(seed), []
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(5000)]
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.randint(120, 400))
        out.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return list(enumerate(out))


def kept(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in near_texts.first_of_near(docs, **more).collect())


def test_near_copies_of_the_table_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in near_texts.first_of_near(docs).select("doc_id").collect()}
    want, removable = first_ids(docs.select("doc_id", "text").collect())
    assert removable >= 40
    assert not want - left, "a clean document is gone"
    assert len(left - want) <= 0.1 * removable


@pytest.mark.parametrize("bucket_limit", [near_texts.BUCKET_LIMIT, 3])
def test_groups_of_edited_copies(spark, bucket_limit):
    rows = made_texts(5, 12, 9, 2) + [(1000 + i, t) for i, t in made_texts(6, 40, 0, 0)]
    want, removable = first_ids(rows)
    left = set(kept(spark, rows, bucket_limit=bucket_limit))
    assert removable > 90
    assert not want - left and len(left - want) <= 0.05 * removable


def test_links_are_only_kept_above_the_least_similarity(spark):
    base = [f"w{i}" for i in range(104)]
    near, far = list(base), list(base)
    for i in (20, 50):
        near[i] = "x"
    for i in (20, 50, 80):
        far[i] = "x"
    # 90 of 110 shingles are shared, then 85 of 115.
    rows = [(1, " ".join(base)), (2, " ".join(near))]
    assert kept(spark, rows) == [1]
    assert kept(spark, [(1, " ".join(base)), (2, " ".join(far))]) == [1, 2]


def test_one_large_group_needs_no_pairs(spark):
    rows = made_texts(7, 1, 600, 1)
    classes = spark.createDataFrame(rows, "doc_id long, text string").select(near_texts.signature("text").alias("s"))
    classes = near_texts.materialize(classes.select("s.*").distinct())
    for limit in (near_texts.BUCKET_LIMIT, 50):
        assert near_texts.proposals(classes, limit).count() <= near_texts.key_count(near_texts.KEY_BITS) * len(rows)
        assert kept(spark, rows, bucket_limit=limit) == [0]


def test_first_word_of_the_signature_is_the_operators(spark):
    for text in (None, "", "one", "One two THREE four", " ".join(f"w{i % 7}" for i in range(300)), "é ü\x0bß"):
        assert near_texts.signature_of(text)[1] == simhash.fingerprint_of(text)


def test_equal_but_for_case_and_blanks(spark):
    rows = [(4, "Some Words\there and there"), (3, "some words here and  there "), (9, "É a b c"), (8, "é a b c")]
    assert kept(spark, rows) == [3, 8, 9]


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t"), (None, ""), (1, "a b"), (1, "a b"), (1, "c d e"), (None, "x y"), (None, "x y")]
    assert sorted(kept_rows(spark, rows), key=str) == sorted([(5, None), (1, "a b"), (1, "c d e"), (None, "x y")], key=str)


def kept_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return list(map(tuple, near_texts.first_of_near(docs).collect()))


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = [f"{rng.randrange(10**6)}" for _ in range(150_000)]
    other = long[:70_000] + ["x"] + long[70_001:]
    assert kept(spark, [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(reversed(long)))]) == [1, 3]


def test_more_bits_need_more_keys():
    assert [near_texts.key_count(b) for b in (16, 20, 32)] == [51, 99, 708]
    assert all(sum(bin(m % 2**64).count("1") for m in mask) == 16 for mask in near_texts.masks(16))


def test_empty_table(spark):
    assert kept(spark, []) == []


def test_clashing_names_and_kept_columns(spark):
    names = ["doc_id", "text", "node", "s0", "_near_id", "_near_body", "_NEAR_node", "_near_n", "key", "hi", "lo", "group", "body"]
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame(
        [(i, t, *[i * 10] * 11) for i, t in [(1, text), (2, text + " more"), (3, "alone"), (3, "alone")]],
        ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names),
    )
    out = near_texts.first_of_near(docs)
    assert out.columns == names
    assert sorted(r[:1] + r[2:] for r in map(tuple, out.collect())) == [(1, *[10] * 11), (3, *[30] * 11)]


def test_other_column_names(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "X y")], "k string, body string")
    assert [tuple(r) for r in near_texts.first_of_near(docs, "k", "body").collect()] == [("a", "x y")]


def test_links_join_what_brute_force_compares(spark):
    rows = made_texts(8, 3, 6, 3)
    docs = spark.createDataFrame(rows, "node long, text string")
    sets = near_texts.materialize(docs.select("node", near_texts.shingle_set("text").alias("shingles")))
    pairs = docs.select(F.col("node").alias("lo")).join(docs.select(F.col("node").alias("hi")), F.expr("hi > lo"))
    got = {(r.lo, r.hi) for r in near_texts.verified(pairs, sets).collect()}
    assert got == similar_pairs([t for _, t in rows])


def test_pivots_discard_no_near_pair_and_each_key_is_dealt_once(spark, monkeypatch):
    rows = made_texts(9, 6, 5, 2)
    classes = spark.createDataFrame(rows, "doc_id long, text string").select(near_texts.signature("text").alias("s"))
    classes = near_texts.materialize(classes.select("s.*").distinct())
    dealt, written = [], near_texts.materialize
    monkeypatch.setattr(near_texts, "materialize", lambda df, label="step": dealt.append(label) or written(df, label))

    large = {(r.hi, r.lo) for r in near_texts.proposals(classes, 3).collect()}
    assert large and "members" not in dealt and dealt.count("buckets") > 1
    frame = classes.select("node", *near_texts.SIGNATURE, F.explode(near_texts.bucket_keys(12)).alias("key")).toPandas().sort_values(["key", "node"])

    def links():
        return sorted(map(tuple, next(near_texts.leader_links(iter([frame, frame[:0]]))).to_numpy().tolist()))

    small = links()
    # Any pivots propose what the words alone do.
    monkeypatch.setattr(near_texts, "pivots", lambda: [[0, 0, 0, 0]] * 2)
    assert links() == small and small
    assert {(r.hi, r.lo) for r in near_texts.proposals(classes, 3).collect()} == large


def test_keys_grow_with_the_texts():
    assert [near_texts.bits_for(n) for n in (0, 10**5, 10**7, 10**9)] == [12, 12, 16, 22]
    assert len(near_texts.pivots()) == near_texts.PIVOTS


def test_a_sieve_passes_all_its_keys_and_few_others(spark, monkeypatch):
    rows = spark.range(-20000, 20000).select("id", F.xxhash64("id").alias("h"))
    for most, share in ((1 << 11, 0.1), (1, 0.2)):
        monkeypatch.setattr(near_texts, "MOST_SLOTS", most)
        for keys in (rows.where("id % 7 = 0"), rows.where("id < -20000"), rows.where("id = 3")):
            out = near_texts.sieved(rows, F.col("h"), keys.select(F.col("h").alias("key")), "open")
            assert out.columns == ["id", "h", "open"] and out.count() == 40000
            passed = out.where("open")
            assert keys.join(passed, "id", "left_anti").isEmpty()
            assert passed.count() - keys.count() <= share * 40000


def test_most_texts_stay_where_they_are_scanned(spark, monkeypatch):
    rows = made_texts(10, 300, 0, 0) + [(1000 + i, t) for i, t in made_texts(11, 6, 4, 2)]
    want, _ = first_ids(rows)
    docs = near_texts.materialize(spark.createDataFrame(rows, "doc_id long, text string"))
    moved, sieved = [], near_texts.sieved

    def noted(rows, key, keys, name):
        out = sieved(rows, key, keys, name)
        moved.append(out.where(name).count())
        return out

    monkeypatch.setattr(near_texts, "sieved", noted)
    out = near_texts.first_of_near(docs)
    assert not want - {r.doc_id for r in out.select("doc_id").collect()}
    # Once for the shingles of what is in a pair, once for what goes or is repeated.
    assert len(moved) == 2 and all(24 <= n <= 80 for n in moved)
    assert near_texts.first_of_near(docs.union(docs)).count() == out.count()


def related_pairs(seed, pairs, words=300):
    """Texts in similar pairs; texts of different pairs are near, but not similar enough."""
    rng, out = random.Random(seed), []
    base = [f"w{i}" for i in range(words)]
    for p in range(pairs):
        one = [f"p{p}" if i % 5 == 0 and rng.random() < 0.25 else w for i, w in enumerate(base)]
        other = list(one)
        other[rng.randrange(words)] = f"q{p}"
        out += [" ".join(one), " ".join(other)]
    return list(enumerate(out))


@pytest.mark.parametrize("pairs, bucket_limit, cell", [(400, near_texts.BUCKET_LIMIT, None), (40, 3, None), (40, near_texts.BUCKET_LIMIT, 5000), (40, 3, 1)])
def test_no_pair_is_lost_to_a_leader_that_fails(spark, monkeypatch, pairs, bucket_limit, cell):
    if cell:
        monkeypatch.setattr(near_texts, "CELL", cell)
    rows = related_pairs(2, pairs)
    want, removable = first_ids(rows)
    assert removable >= pairs
    assert set(kept(spark, rows, bucket_limit=bucket_limit)) == want


def test_what_a_leader_takes_leads_in_turn(spark):
    # Rows 0 and 1 are near, 1 and 2 are, 0 and 2 are not; 3 is alone.
    bits = [0, (1 << 60) - 1, (1 << 120) - 1, (1 << 240) - 1 - ((1 << 120) - 1)]
    words = [[(b >> 64 * i & 2**64 - 1) for i in range(4)] for b in bits]
    signed = [[w - (1 << 64) if w >> 63 else w for w in one] for one in words]
    for order in ([0, 1, 2, 3], [2, 0, 3, 1], [3, 0, 2, 1], [1, 3, 2, 0]):
        frame = near_texts.pd.DataFrame([[k, n, *signed[n]] for k in (5, 6) for n in order], columns=["key", "node", *near_texts.SIGNATURE])
        found = [tuple(r) for part in near_texts.leader_links(iter([frame])) for r in part.to_numpy().tolist()]
        assert sorted(found) == [(1, 0)] * 2 + [(2, 1)] * 2


def test_cells_are_bounded_and_every_two_parts_meet(spark):
    rows = [(n, 10, n % 3 if n < 90 else 1000 + n, n if n >= 60 else n % 6) for n in range(90)] + [(200, 5, 200, 200), (300, 1, 300, 300), (301, 1, 300, 301)]
    members = near_texts.in_cells(spark.createDataFrame(rows, "node long, size int, family long, root long"), 5 * 266).collect()
    # Families of one part or of two rows have nothing left to compare.
    assert sorted(r.node for r in members) == list(range(90))
    sizes = Counter((r.family, r.cell) for r in members)
    assert max(sizes.values()) <= 12 and len(sizes) > 12
    assert {r.own for r in members if r.node < 60} == set(range(6)) and {r.own for r in members if r.node >= 60} == {None}
