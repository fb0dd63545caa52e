"""Benchmark decontamination: prefix-filtered set join on DataFrame functions.

A benchmark item's windows are its runs of ``WINDOW`` words (one shorter window
for a shorter item).  The words of all windows are ordered by rarity in the
documents; since a window must be contained whole, its rarest word alone is a
necessary prefix.  Document words join the prefix words; positional bounds (the
window begins and ends inside the document) and the length of the document
follow from the prefix's place, and the candidate window is then compared word
by word.  Windows equal in several items are one, and carry the name of their set of items only: the items
of a set are joined at the end, once for each combination of sets that documents have.

The anchors are broadcast in blocks of at most ``BLOCK_WINDOWS`` windows, however many
the benchmark has; each block is one pass over the documents.  Words are split and compared in
the same stage that scans the text; only hits and one narrow row per document
leave it.

Null and empty texts and empty tables have no words and no hits; texts of any length are one row each; items without words have no
windows; a null item_id marks words as hit but is not listed.  Repeated rows are
returned as often as they occur.  Items that share an id count once.  Other columns
are kept by ``clean`` and ignored by ``contamination``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import ascii_lower, raw_words, unused
from chunkloom.session import materialize

WINDOW = 10
BLOCK_WINDOWS = 20_000
# Ends every word list; no word contains it.
END = "\n"


def item_windows(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """(item_id, words, first): every item's words and the start of each window."""
    words = F.transform(raw_words(F.col(text_column)), ascii_lower)
    items = benchmark.select(F.col(item_column).cast("string").alias("item_id"), words.alias("words")).where(
        F.size("words") > 0
    )
    last = F.greatest(F.size("words") - WINDOW, F.lit(0))
    return items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("first"))


def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, body, words, pos, word): each word of each document and one END.

    The list is never empty; the outer form only keeps the optimizer from
    splitting the text once more to check that.
    """
    words = F.concat(raw_words(F.col(text_column)), F.array(F.lit(END)))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("body"), words.alias("words")
    )
    return rows.select("doc_id", "body", "words", F.posexplode_outer("words").alias("pos", "word"))


def word_counts(docs: DataFrame, vocabulary: DataFrame, text_column: str) -> DataFrame:
    """How often all documents use each word of a small vocabulary (word, uses)."""
    used = docs.select(F.explode_outer(raw_words(F.col(text_column))).alias("raw")).select(F.lower("raw").alias("word"))
    return used.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("uses"))


def keyed_windows(windows: DataFrame) -> DataFrame:
    """(item_id, span, key): each window's words, and these joined by blanks."""
    span = F.slice("words", F.col("first") + 1, WINDOW)
    return windows.select("item_id", span.alias("span")).withColumn("key", F.array_join("span", " "))


def window_sets(parts: DataFrame) -> DataFrame:
    """(key, set): windows that the same items hold have the same set.

    A set is named by the number of its items and two sums of their hashes, so no list of items is formed.
    """
    pairs = parts.select("key", "item_id").distinct()
    sums = [F.sum(F.xxhash64(*seed, "item_id").cast("decimal(38,0)")).cast("string") for seed in ([], [F.lit(1)])]
    return pairs.groupBy("key").agg(F.md5(F.concat_ws(",", F.count("item_id").cast("string"), *sums)).alias("set"))


def set_items(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, item_id): the items of each set, from one of its windows."""
    one = sets.groupBy("set").agg(F.min("key").alias("key"))
    return parts.select("key", "item_id").where("item_id IS NOT NULL").distinct().join(one, "key").select("set", "item_id")


def anchors_of(parts: DataFrame, sets: DataFrame, uses: DataFrame) -> DataFrame:
    """(word, before, size, key, head, set): each distinct window by its prefix word.

    ``before`` is the prefix word's distance from the window's start, ``key`` the
    window's words joined by blanks and ``head`` the first of them.
    """
    one = parts.groupBy("key").agg(F.any_value("span").alias("span")).join(sets, "key")
    places = one.select("key", F.posexplode("span").alias("before", "word"))
    # In the form in which the words of documents are met; see ``window_hits``.
    ranked = places.withColumn("word", F.lower("word")).join(uses, "word", "left")
    rarest = ranked.groupBy("key").agg(
        F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word", "before")).alias("rarest")
    )
    return one.join(rarest, "key").select(
        F.col("rarest.word").alias("word"),
        F.col("rarest.before").alias("before"),
        F.size("span").alias("size"),
        "key",
        F.lower(F.get("span", F.lit(0))).alias("head"),
        "set",
    )


def window_hits(docs: DataFrame, anchors: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, body, n_words, first, last, set): each place where a window occurs,
    plus one row with null ``set`` for each document.

    Words meet lower-cased in full, which never separates equal words; the
    comparison of the whole window lower-cases only A-Z.
    """
    end = docs.sparkSession.range(1).select(
        *(F.lit(END if f.name == "word" else None).cast(f.dataType).alias(f.name) for f in anchors.schema)
    )
    found = occurrences(docs, id_column, text_column)
    needles = F.broadcast(anchors.union(end))
    first = F.col("pos") - F.col("before")
    n_words = F.size("words") - 1
    inside = (first >= 0) & (first + F.col("size") <= n_words)
    text = F.array_join(F.slice("words", first + 1, F.col("size")), " ")
    occurs = inside & (F.lower(F.get("words", first)) == F.col("head")) & (ascii_lower(text) == F.col("key"))
    # One expression with a fixed order of evaluation: no slice is taken outside the document.
    matches = F.when(F.col("key").isNull(), True).when(~inside, False).otherwise(occurs)
    return (
        found.join(needles, (F.lower(found.word) == anchors.word) & matches)
        .select("doc_id", "body", n_words.alias("n_words"), first.alias("first"), (first + F.col("size")).alias("last"), "set")
    )


def covered(spans: Column) -> Column:
    """How many positions a sorted array of (first, last) covers, overlaps once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["end"]))
        return F.struct(F.greatest(acc["end"], s["last"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def all_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> tuple[DataFrame, DataFrame]:
    """Written hits as ``window_hits`` gives them, and the items (set, item_id) of their sets."""
    windows = item_windows(benchmark, item_column, item_text_column)
    vocabulary = materialize(
        windows.select(F.explode(F.slice("words", F.col("first") + 1, WINDOW)).alias("word")).select(F.lower("word").alias("word")).distinct(),
        "vocabulary",
    )
    blocks = range(max(1, -(-vocabulary.count() // block_windows)))
    block_of = F.pmod(F.xxhash64("word"), F.lit(len(blocks)))
    uses = reduce(
        DataFrame.union, (word_counts(docs, vocabulary.where(block_of == b), text_column) for b in blocks)
    )
    parts = keyed_windows(windows)
    sets = materialize(window_sets(parts), "sets")
    anchors = materialize(anchors_of(parts, sets, uses), "anchors")
    blocks = range(max(1, -(-anchors.count() // block_windows)))
    block_of = F.pmod(F.xxhash64("key"), F.lit(len(blocks)))
    hits = [window_hits(docs, anchors.where(block_of == b), id_column, text_column) for b in blocks]
    # Written first: collecting sets then holds nothing of the stage that splits the texts.
    hits = materialize(reduce(DataFrame.union, [hits[0], *(h.where("set IS NOT NULL") for h in hits[1:])]), "hits")
    return hits, set_items(parts, sets)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and text: doc_id, body (hash of the text), rows (how
    often it occurs), n_words, n_hit, items (sorted).  Options as for ``all_hits``.

    Documents with the same sets share one list of items, formed once.
    """
    hits, members = all_hits(docs, benchmark, **options)
    is_hit = F.col("set").isNotNull()
    found = materialize(
        hits.groupBy("doc_id", "body")
        .agg(
            F.count_if(~is_hit).alias("rows"),
            F.max("n_words").cast("long").alias("n_words"),
            F.array_sort(F.collect_set(F.when(is_hit, F.struct("first", "last")))).alias("spans"),
            F.array_sort(F.collect_set("set")).alias("sets"),
        )
        .select("doc_id", "body", "rows", "n_words", covered(F.col("spans")).alias("n_hit"), "sets"),
        "found",
    )
    lists = found.where(F.size("sets") > 0).select("sets").distinct()
    items = lists.select("sets", F.explode("sets").alias("set")).join(members, "set").select("sets", "item_id").distinct()
    listed = materialize(items.groupBy("sets").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "items")
    none = F.array().cast("array<string>")
    return found.join(listed, "sets", "left").select("doc_id", "body", "rows", "n_words", "n_hit", F.coalesce("items", none).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs, benchmark, **options).select(
        F.explode(F.array_repeat("doc_id", F.col("rows").cast("int"))).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without any hit, columns as they are."""
    hits, _ = all_hits(docs, benchmark, id_column=id_column, text_column=text_column)
    names = unused(docs, "_hit_id"), unused(docs, "_hit_body")
    hit = hits.where("set IS NOT NULL").select("doc_id", "body").distinct().toDF(*names)
    same = docs[id_column].eqNullSafe(F.col(names[0])) & (F.xxhash64(docs[text_column]) == F.col(names[1]))
    return docs.join(materialize(hit, "hit"), same, "left_anti")
