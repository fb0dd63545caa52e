"""One document of each group of near copies: SimHash proposes, five-word shingles decide.

``simhash`` links fingerprints within three bits.  Texts that share four fifths of
their five-word shingles lie further apart, some eight bits of 64, beyond what blocks
of one fingerprint can find.  Here a text has a wide fingerprint of four words, the
first being that of ``simhash``; fixed masks of ``key_bits`` of its 256 bits
are its bucket keys.  Two texts at the least similarity differ in some 15 % of the bits, so there are
as many keys as let ``FOUND`` of such pairs meet.  A bucket holds some ``STRANGERS`` at most: ``key_bits``
grows with the logarithm of the number of texts, and the number of keys follows.  Inside a bucket the fingerprints'
Hamming distances to reference ones (pivots) are computed once, as in ``simhash``: a pair whose distances to any pivot
differ by more than ``RADIUS`` cannot be near and is discarded.  What is left and differs in at most
``RADIUS`` of the 256 bits, which strangers hardly ever do, is proposed, and a proposal becomes a link if the Jaccard similarity of
the sets of five-word shingles is at least ``LEAST``: no link is wrong.

A bucket proposes a forest, not pairs: its first member by a hash leads, members near it are
proposed with it and lead in turn, and the others choose again.  Small buckets do so inside one task, to which
each key comes once; those beyond ``bucket_limit`` rows choose leaders only, by aggregates and salted joins.
What the forests (and the large buckets) join is a family: whatever two texts are near in a bucket are in one.  A family that the
links of its proposals leave in several parts is compared whole, so that no text depends on its leaders: its members
are dealt into cells of bounded size, and each two cells that may hold a link meet in a task,
which looks for shared rare shingles (a pair at ``LEAST`` has one among its rarest fifth) and counts what candidates share.
A part that fills cells of its own is not compared with itself.  So every pair that is near in a bucket and
similar is joined, at a cost that grows with the square of a family's parts, and a task holds two cells.

Texts are moved as little as possible: a bitmap of hashed keys tells the documents that a join may need
from the others, which stay where they are scanned.

Texts that are equal but for the case of A-Z and for white space are one class and always
copies; null, empty and wordless texts are one such class.  A text of fewer than five
words has one shingle, all its words.  Very long texts are hashed in blocks.  Ties: the
smallest id stays, among rows that share it the one with the smallest hash of text; rows
repeated with id and text stay once.  A group without ids keeps one row.
Empty tables give empty ones, other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from chunkloom.llm.common import mix, unused
from chunkloom.llm.simhash import SEED
from chunkloom.llm.simhash import SHINGLE as PRINT_SHINGLE
from chunkloom.plans.components import connected_components
from chunkloom.plans.skew import join_salted
from chunkloom.session import materialize

SHINGLE = 5
LEAST = 0.8
WORDS = 4
# Bits of a key, at least.
KEY_BITS = 12
STRANGERS = 256
# Keys, at least: each may have another leader.
KEYS = 36
DIFFERING = 0.15
FOUND = 0.98
RADIUS = 17 * WORDS
BUCKET_LIMIT = 2048
BLOCK = 65536
# Few, as so wide a radius seldom lets them discard a pair.
PIVOTS = 8
SIGNATURE = [f"s{i}" for i in range(WORDS)]
# Weight of a cell, in shingles; each member weighs some more.
CELL = 1 << 19
MEMBER = 256
# Bits of a sieve for each of its keys, and of one of its slots. A sieve has 8 MB at most; with more
# keys than that is made for it lets more rows through to the join behind it.
SIEVE_BITS = 32
SLOT_BITS = 1 << 15
MOST_SLOTS = 1 << 11


def key_count(key_bits: int) -> int:
    """Keys that let a pair with ``DIFFERING`` bits share one with probability ``FOUND`` at least."""
    return max(KEYS, math.ceil(math.log(1 - FOUND) / math.log(1 - (1 - DIFFERING) ** key_bits)))


def bits_for(texts: int) -> int:
    """Bits of a key that leave some ``STRANGERS`` texts in a bucket."""
    return max(KEY_BITS, math.ceil(math.log2(max(1, texts) / STRANGERS)))


def pivots() -> list[list[int]]:
    """Reference fingerprints, as signed numbers."""
    import numpy as np

    return np.random.default_rng(7).integers(0, 1 << 64, (PIVOTS, WORDS), np.uint64).view(np.int64).tolist()


def folded_words(text: str | None) -> list[bytes]:
    """Blank-separated words with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> Iterator:
    """Hashes of all shingles, in blocks; fewer words than ``size`` are one shingle, none give none."""
    import numpy as np
    import xxhash

    digest, total = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    for a in range(0, total if words else 0, BLOCK):
        part = words[a : min(a + BLOCK, total) + size - 1]
        shingles = zip(*(part[i:] for i in range(min(size, len(part)))))
        yield np.array([digest(b" ".join(s), SEED) for s in shingles], "<u8")


def node_of(words: list[bytes]) -> int:
    """A hash of the folded words, as a signed number."""
    import xxhash

    return (xxhash.xxh64_intdigest(b" ".join(words)) ^ 1 << 63) - (1 << 63)


def signature_of(text: str | None) -> list[int]:
    """A hash of the folded words, then the words of the wide fingerprint, as signed numbers."""
    import numpy as np

    words = folded_words(text)
    ones, total = np.zeros((WORDS, 64), np.int64), 0
    for hashes in shingle_hashes(words, PRINT_SHINGLE):
        total += len(hashes)
        for i in range(WORDS):
            # The first word is the operator's own; the others come from mixed hashes.
            mixed = mix(hashes + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) if i else hashes
            bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[i] += bits.sum(axis=0, dtype=np.int32)
    prints = np.packbits(ones * 2 > total, axis=1, bitorder="little").view("<i8")[:, 0]
    return [node_of(words), *map(int, prints)]


@F.pandas_udf(StructType([StructField(name, LongType()) for name in ("node", *SIGNATURE)]))
def signature(texts: pd.Series) -> pd.DataFrame:
    """Signatures of a column of texts."""
    rows = [signature_of(t) for t in texts]
    return pd.DataFrame(rows, columns=["node", *SIGNATURE], dtype="int64")


def shingles_of(text: str | None):
    """The distinct hashed five-word shingles of a text."""
    import numpy as np

    blocks = list(shingle_hashes(folded_words(text), SHINGLE))
    return np.unique(np.concatenate(blocks)).view(np.int64) if blocks else np.empty(0, np.int64)


@F.pandas_udf(ArrayType(LongType()))
def shingle_set(texts: pd.Series) -> pd.Series:
    """The shingles of a column of texts."""
    return texts.map(shingles_of)


def shingle_rows(frames: Iterator) -> Iterator:
    """Rows of one column of texts -> (node, shingles)."""
    for frame in frames:
        texts = frame.iloc[:, 0]
        yield pd.DataFrame({"node": [node_of(folded_words(t)) for t in texts], "shingles": texts.map(shingles_of)})


def masks(key_bits: int = KEY_BITS) -> list[list[int]]:
    """For each key the bits it looks at, as one signed mask for each word of the signature."""
    import numpy as np

    rng, out = np.random.default_rng(11), []
    for _ in range(key_count(key_bits)):
        chosen = np.zeros(64 * WORDS, np.uint8)
        chosen[rng.permutation(64 * WORDS)[:key_bits]] = 1
        out.append([int(m) for m in np.packbits(chosen.reshape(WORDS, 64), axis=1, bitorder="little").view("<i8")[:, 0]])
    return out


def bucket_keys(key_bits: int = KEY_BITS) -> Column:
    """One key for each mask; a shared key only proposes."""
    return F.array(
        *(
            F.xxhash64(F.lit(n), *(F.col(s).bitwiseAND(F.lit(m)) for s, m in zip(SIGNATURE, chosen)))
            for n, chosen in enumerate(masks(key_bits))
        )
    )


def _apart(one: list, other: list) -> Column:
    """Differing bits of two fingerprints."""
    return reduce(Column.__add__, [F.bit_count(F.col(a).bitwiseXOR(b)) for a, b in zip(one, other)])


def _rank(key: Column, node: Column) -> Column:
    return F.xxhash64(key, node)


def leader_links(frames: Iterator) -> Iterator:
    """Rows (key, node, s0, ...) sorted by key and rank -> links (hi, lo) that join whatever is near; a bucket may span frames."""
    import numpy as np

    references = np.array(pivots())

    def links(frame):
        keys, nodes, prints = frame["key"].to_numpy(), frame["node"].to_numpy(), frame[SIGNATURE].to_numpy()
        # Buckets of one row have no links.
        same = np.r_[False, keys[1:] == keys[:-1], False]
        rest = np.flatnonzero(same[1:] | same[:-1])
        bucket = np.cumsum(~same[:-1]) - 1
        waiting, buckets = rest[:0], len(frame) - int(same.sum())
        highs, lows = [], []
        distances = np.bitwise_count((prints[:, None] ^ references).view(np.uint64)).sum(axis=2, dtype=np.int16)
        while len(rest):
            # In each bucket the first that waits to lead, else the first of the rest: of equal places the last one written counts.
            lead = np.full(buckets, -1)
            lead[bucket[rest[::-1]]] = rest[::-1]
            open_buckets = lead >= 0
            waiting = waiting[open_buckets[bucket[waiting]]]
            lead[bucket[waiting[::-1]]] = waiting[::-1]
            waiting, rest = (part[lead[bucket[part]] != part] for part in (waiting, rest))
            leader = lead[bucket[rest]]
            near = np.abs(distances[rest] - distances[leader]).max(axis=1) <= RADIUS
            apart = (prints[rest[near]] ^ prints[leader[near]]).view(np.uint64)
            near[near] = np.bitwise_count(apart).sum(axis=1, dtype=np.int16) <= RADIUS
            linked = near & (nodes[rest] != nodes[leader])
            a, b = nodes[rest[linked]], nodes[leader[linked]]
            highs.append(np.maximum(a, b))
            lows.append(np.minimum(a, b))
            waiting, rest = np.r_[waiting, rest[near]], rest[~near]
        return pd.DataFrame({"hi": np.concatenate(highs), "lo": np.concatenate(lows)} if highs else {"hi": [], "lo": []}, dtype="int64")

    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = frame["key"].to_numpy()
        cut = len(frame) if not len(frame) else int(np.flatnonzero(last == last[-1])[0])
        held = frame.iloc[cut:].reset_index(drop=True)
        yield links(frame.iloc[:cut].reset_index(drop=True))
    if held is not None:
        yield links(held)


def leader_round(members: DataFrame) -> DataFrame:
    """The same choice once for buckets of any size: ``members`` with their leader and whether it is near."""
    lead = F.min(F.struct(_rank(F.col("key"), F.col("node")).alias("rank"), "node", *SIGNATURE)).alias("lead")
    leaders = members.groupBy("key").agg(lead, F.count(F.lit(1)).alias("n"))
    prints = [f"lead_{name}" for name in SIGNATURE]
    ends = [F.col(f"lead.{name}").alias(p) for name, p in zip(SIGNATURE, prints)]
    leaders = leaders.select("key", "n", F.col("lead.node").alias("leader"), *ends)
    # The distance of a member to a pivot against its leader's, then their own.
    far = [F.abs(_apart(SIGNATURE, p) - _apart(prints, p)) for p in [[F.lit(word) for word in pivot] for pivot in pivots()]]
    near = (F.greatest(*far) <= RADIUS) & (_apart(SIGNATURE, [F.col(p) for p in prints]) <= RADIUS)
    return join_salted(members, leaders, "key", F.col("node")).withColumn("near", near)


def proposals(classes: DataFrame, bucket_limit: int = BUCKET_LIMIT, key_bits: int | None = None) -> DataFrame:
    """``classes(node, s0, s1, ...)`` -> distinct pairs (hi, lo) worth a comparison."""
    return proposals_and_mates(classes, bucket_limit, key_bits)[0]


def proposals_and_mates(classes: DataFrame, bucket_limit: int = BUCKET_LIMIT, key_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The proposals, and pairs (hi, lo) that join the members of each large bucket, near or not."""
    bits = key_bits or bits_for(classes.count())
    rest = classes.select("node", *SIGNATURE, F.explode(bucket_keys(bits)).alias("key"))
    found, mates = [], []
    while True:
        # Large buckets are few, at most one for each ``bucket_limit`` rows; all others go to their task at once.
        sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = F.broadcast(materialize(sizes.where(F.col("n") > bucket_limit).select("key"), "buckets"))
        found.append(
            rest.join(large, "key", "left_anti")
            .select("key", "node", *SIGNATURE)
            .repartition("key")
            .sortWithinPartitions(F.col("key"), _rank(F.col("key"), F.col("node")))
            .mapInPandas(leader_links, "hi long, lo long")
        )
        hot = rest.join(large, "key", "left_semi").select("key", "node", *SIGNATURE)
        if hot.isEmpty():
            pairs = materialize(reduce(DataFrame.union, found).distinct(), "proposals")
            return pairs, reduce(DataFrame.union, mates or [pairs.limit(0)]).distinct()
        led = materialize(leader_round(hot), "led")
        ends = F.greatest("node", "leader").alias("hi"), F.least("node", "leader").alias("lo")
        # What is far from the leader of now is near others, which the leader's members are not compared with here.
        mates.append(led.where("NOT near").select(*ends))
        found.append(led.where("near AND node != leader").select(*ends))
        rest = led.where("NOT near").select("node", *SIGNATURE, "key")


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (hi, lo) whose sets (node, shingles) have a Jaccard similarity of at least ``least``."""
    upper = sets.select(F.col("node").alias("hi"), F.col("shingles").alias("a"))
    lower = sets.select(F.col("node").alias("lo"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(upper, "hi").join(lower, "lo").where(
        both >= least * (F.size("a") + F.size("b") - both) - 1e-9
    ).select("hi", "lo")


def labelled(sets: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``sets`` with the component of each node as ``name``."""
    roots = connected_components(links).select(F.col("node").alias("_member"), F.col("root").alias("_root"))
    joined = sets.join(roots, sets["node"] == roots["_member"], "left")
    return joined.withColumn(name, F.coalesce("_root", "node")).drop("_member", "_root")


def in_cells(members: DataFrame, cell: int) -> DataFrame:
    """``members(node, size, family, root)`` of the families to be compared -> (family, cell, own, node, root).

    Parts of a cell's weight or more have cells of their own, with the part's root as ``own``; the others of a family share cells.
    """
    weight = F.sum(F.col("size") + MEMBER)
    parts = members.groupBy("root").agg(F.min("family").alias("family"), F.count(F.lit(1)).alias("members"), weight.alias("weight"))
    small = F.when(F.col("weight") < cell, F.col("weight")).otherwise(0)
    families = parts.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("members").alias("all"), F.sum(small).alias("shared"))
    # Of two members the pair has been compared already.
    families = families.where("n > 1 AND all > 2").select("family", "n", "shared")
    parts = join_salted(parts, families, "family", F.col("root"))
    parts = parts.select("root", F.col("members").alias("n"), "weight", "shared")
    own = F.when(F.col("weight") >= cell, F.col("root"))
    many = F.greatest(F.ceil(F.when(own.isNull(), F.col("shared")).otherwise(F.col("weight")) / cell), F.lit(1))
    dealt = F.pmod(F.when(own.isNull(), F.xxhash64("root")).otherwise(F.xxhash64("node")), many)
    out = join_salted(members, parts, "root", F.col("node")).withColumn("own", own)
    return out.select("family", F.concat_ws("_", "own", dealt).alias("cell"), "own", "node", "root")


def exact_links(table: pa.Table) -> pa.Table:
    """Rows (side, node, root, shingles) of two cells, or of one -> links (hi, lo) that join the roots of similar rows."""
    import numpy as np

    nodes, roots, side = (table[c].to_numpy() for c in ("node", "root", "side"))
    sets = table["shingles"].combine_chunks()
    sizes = sets.value_lengths().to_numpy()
    starts = np.r_[0, np.cumsum(sizes)]
    _, ids, counts = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    # Shingles numbered from the rarest, in this order in each row.
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    row = np.repeat(np.arange(len(nodes)), sizes)
    ids = rank[ids]
    ids = ids[np.lexsort((ids, row))]
    # Rows that share fewer than the least number have none of these in common.
    heads = sizes - np.ceil(LEAST * sizes - 1e-9).astype(np.int64) + 1
    head = np.arange(len(ids)) - starts[row] < heads[row]
    by_id = np.argsort(ids[head], kind="stable")
    holders, begins = row[head][by_id], np.searchsorted(ids[head][by_id], np.arange(len(counts) + 1))
    part, crossed = np.unique(roots, return_inverse=True)[1], side.min() != side.max()
    shared, highs, lows = np.zeros(len(counts), bool), [], []
    for x in range(len(nodes)):
        own = ids[starts[x] : starts[x + 1]]
        first = own[: heads[x]] if len(own) else own
        held = [holders[begins[i] : begins[i + 1]] for i in first[begins[first + 1] - begins[first] > 1]]
        if not held:
            continue
        met = np.unique(np.concatenate(held))
        met = met[(met < x) & (part[met] != part[x])]
        met = met[np.minimum(sizes[met], sizes[x]) >= LEAST * np.maximum(sizes[met], sizes[x]) - 1e-9]
        met = met[side[met] != side[x]] if crossed else met
        if not len(met):
            continue
        shared[own] = True
        theirs = shared[np.concatenate([ids[starts[y] : starts[y + 1]] for y in met])]
        both = np.add.reduceat(theirs, np.r_[0, np.cumsum(sizes[met])[:-1]], dtype=np.int64)
        shared[own] = False
        for y in met[both >= LEAST * (sizes[met] + sizes[x] - both) - 1e-9]:
            if part[y] != part[x]:
                part[part == part[y]] = part[x]
                highs.append(max(nodes[x], nodes[y]))
                lows.append(min(nodes[x], nodes[y]))
    return pa.table({"hi": pa.array(highs, pa.int64()), "lo": pa.array(lows, pa.int64())})


def family_links(sets: DataFrame, links: DataFrame, family: DataFrame, cell: int | None = None) -> DataFrame:
    """The links (hi, lo) that ``links`` lack so that all similar ``sets(node, size, shingles)`` of a family are joined; ``family(hi, lo)`` joins families."""
    members = labelled(labelled(sets.select("node", "size"), family, "family"), links, "root")
    members = materialize(in_cells(materialize(members, "members"), cell or CELL), "cells")
    cells = members.groupBy("family", "cell").agg(F.first("own").alias("own"))
    a, b = cells.alias("a"), cells.alias("b")
    meet = a.join(b, F.expr("a.family = b.family AND a.cell <= b.cell AND coalesce(a.own != b.own, true)"))
    ends = [F.struct(F.lit(0).alias("side"), F.col("a.cell").alias("cell")), F.struct(F.lit(1).alias("side"), F.col("b.cell").alias("cell"))]
    ends = F.explode(F.when(F.expr("a.cell = b.cell"), F.array(ends[0])).otherwise(F.array(*ends))).alias("end")
    meet = meet.select("a.family", F.concat_ws(" ", "a.family", "a.cell", "b.cell").alias("meeting"), ends).select("family", "meeting", "end.*")
    dealt = members.select("family", "cell", "node", "root").join(meet, ["family", "cell"])
    dealt = dealt.select("meeting", "side", "node", "root").join(sets.select("node", "shingles"), "node")
    return materialize(dealt.groupBy("meeting").applyInArrow(exact_links, "hi long, lo long"), "family_links")


def sieved(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``, false where ``key`` is none of ``keys(key)`` for sure, by a broadcast bitmap."""
    slots = min(MOST_SLOTS, max(1, math.ceil(keys.count() * SIEVE_BITS / SLOT_BITS)))
    slot, bits = unused(rows, f"{name}_slot"), unused(rows, f"{name}_bits")

    def place(one: Column) -> tuple[Column, Column]:
        at = F.pmod(one, F.lit(slots * SLOT_BITS))
        return F.floor(at / SLOT_BITS), at % SLOT_BITS

    held, bit = place(F.col("key"))
    held = keys.groupBy(held.alias(slot)).agg(F.bitmap_construct_agg(bit).alias(bits))
    here, bit = place(key)
    byte = F.conv(F.hex(F.substr(F.col(bits), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(held), here == F.col(slot), "left").withColumn(name, found).drop(slot, bits)


def first_of_near(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_limit: int = BUCKET_LIMIT,
    key_bits: int | None = None,
) -> DataFrame:
    """The documents with only one of each group of near copies left: the one with the smallest id."""
    body = F.xxhash64(docs[text_column])
    prints = docs.select(docs[id_column].alias("doc_id"), body.alias("body"), signature(docs[text_column]).alias("s"))
    prints = materialize(prints.select("doc_id", "body", "s.*"), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body"))
    classes = materialize(prints.groupBy("node", *SIGNATURE).agg(best.alias("best")), "classes")
    pairs, mates = proposals_and_mates(classes, bucket_limit, key_bits)
    family = pairs.union(mates)

    # Shingles of one row of each class that is in a pair; a few other rows pass the sieve and meet no pair.
    names = {n: unused(docs, f"_near_{n}") for n in ("id", "body", "n", "open")}
    key = F.xxhash64(docs[id_column], body)
    ends = family.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    ends = classes.join(ends, "node", "left_semi").select(F.xxhash64("best.doc_id", "best.body").alias("key"))
    possible = sieved(docs, key, materialize(ends, "ends"), names["open"]).where(names["open"])
    # Not by two Column functions: a test for null that the joins add can call the first once more, in a worker of its own.
    sets = possible.select(docs[text_column]).mapInPandas(shingle_rows, "node long, shingles array<long>")
    sets = materialize(sets.dropDuplicates(["node"]).withColumn("size", F.size("shingles")), "sets")

    links = materialize(verified(pairs, sets), "links")
    links = links.union(family_links(sets, links, family))
    roots = connected_components(links).withColumnRenamed("node", "member")
    heads = roots.select(F.col("root").alias("head")).distinct()
    rooted = classes.join(roots, classes.node == roots.member, "left").withColumn("group", F.coalesce("root", "node"))
    rooted = rooted.join(heads, rooted["group"] == heads["head"], "left")
    # Classes without any link are told apart by their whole signature.
    alone = [F.when(F.col("head").isNull(), F.col(s)).alias(s) for s in SIGNATURE]
    kept = rooted.groupBy("group", *alone).agg(F.min("best").alias("best")).select("best.doc_id", "best.body")
    copies = prints.groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("copies"))
    copies = materialize(copies.where("copies > 1"), "copies")
    kept = kept.alias("k").join(copies.alias("c"), F.expr("k.doc_id <=> c.doc_id AND k.body = c.body"), "left")
    kept = kept.select(
        F.col("k.doc_id").alias(names["id"]),
        F.col("k.body").alias(names["body"]),
        F.coalesce("copies", F.lit(1)).alias(names["n"]),
    )
    kept = materialize(kept, "kept")
    # Most documents stay and occur once: only the others meet what is kept.
    once = kept.where(F.col(names["n"]) == 1).select(names["id"], names["body"])
    is_once = prints["doc_id"].eqNullSafe(F.col(names["id"])) & (prints["body"] == F.col(names["body"]))
    unsettled = prints.join(once, is_once, "left_anti").select(F.xxhash64("doc_id", "body").alias("key"))
    checked = sieved(docs, key, materialize(unsettled, "unsettled"), names["open"])
    settled = checked.where(~F.col(names["open"])).select(*docs.columns)
    same = docs[id_column].eqNullSafe(F.col(names["id"])) & (body == F.col(names["body"]))
    marked = checked.where(names["open"]).join(kept, same)
    single = settled.union(marked.where(F.col(names["n"]) == 1).select(*docs.columns))
    if copies.isEmpty():
        return single
    # Only rows that are repeated with id and text have to meet.
    again = marked.where(F.col(names["n"]) > 1).select(*docs.columns)
    return single.union(again.dropDuplicates([id_column, text_column]))
