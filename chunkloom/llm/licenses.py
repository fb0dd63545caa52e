"""License scans: diagonal voting over rolling word k-grams.

Every document's rolling hashes of ``K`` words join the k-gram positions of the license
templates.  A match of document position p with template position t votes for the
diagonal p - t; votes are counted by diagonal, neighbouring diagonals (words
inserted or left out) are merged where their places follow each other, and a
merged span is verified by the share of the template's words it covers.  Every vote's
k-gram is compared word by word when it joins, so a span rests on equal words.
A whole base phrase on one diagonal is a place of that phrase.

The templates are fixed, so their k-grams have a fixed, small size and are
broadcast; the documents' words are split, hashed and joined in the stage that
scans them, and only votes and one narrow row per document are shuffled.

Null and empty texts have no words: counts 0, no labels, score 0.  Repeated rows
are returned as often as they occur.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import WORD
from chunkloom.session import materialize

K = 3
# Stands for the end of a document among its hashes.
END = 0
# Words that may be inserted or missing between two votes of one span.
SLACK = 6
# Share of a template's words that a span must cover.
COVERAGE = 0.7

# Phrases that make a base label, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening sentences of license notices in common use, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
    " with the license": "apache-2",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that"
    " the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "released under the mit license": "mit",
}


def templates(spark: SparkSession, k: int = K) -> DataFrame:
    """(hash, gram, places): each k-gram of a template and where it stands."""
    rows, texts = [], [*((p, l, True) for p, l in PHRASES.items()), *((p, l, False) for p, l in NOTICES.items())]
    for number, (text, label, base) in enumerate(texts):
        words = text.split()
        for t in range(len(words) - k + 1):
            rows.append((" ".join(words[t : t + k]), number, label, base, len(words), t))
    schema = "gram string, template int, label string, base boolean, size int, t int"
    words = F.split("gram", " ")
    return (
        spark.createDataFrame(rows, schema)
        .groupBy("gram")
        .agg(F.collect_list(F.struct("template", "label", "base", "size", "t")).alias("places"))
        .select(F.xxhash64(*(F.get(words, F.lit(n)) for n in range(k))).alias("hash"), "gram", "places")
    )


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased in full.

    Phrases are ASCII, and the Kelvin sign is the one character outside ASCII
    that would become an ASCII letter; it is kept from that, so the words equal
    a phrase's just when they do with only A-Z lower-cased.
    """
    text = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u03ba")))
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def rolling_hashes(words: Column, k: int = K) -> Column:
    """Hashes of all runs of ``k`` words, then ``END``."""
    first = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
    return F.concat(
        F.transform(first, lambda i: F.xxhash64(*(F.get(words, i + n) for n in range(k)))), F.array(F.lit(END).cast("long"))
    )


def votes(docs: DataFrame, id_column: str, text_column: str, k: int = K) -> DataFrame:
    """(doc_id, body, n_words, p, places): matches of k-grams, and one row with null
    ``places`` for each document."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("body"), words_of(F.col(text_column)).alias("words")
    )
    grams = rows.select("doc_id", "body", "words", F.posexplode_outer(rolling_hashes(F.col("words"), k)).alias("p", "hash"))
    known = templates(docs.sparkSession, k)
    end = docs.sparkSession.range(1).select(
        F.lit(END).cast("long"), F.lit(None).cast("string"), F.lit(None).cast(known.schema["places"].dataType)
    )
    same = F.array_join(F.slice("words", F.col("p") + 1, k), " ") == F.col("gram")
    return (
        grams.join(F.broadcast(known.union(end)), "hash")
        .where(F.col("gram").isNull() | same)
        .select("doc_id", "body", F.size("words").cast("long").alias("n_words"), "p", "places")
    )


def spans(found: DataFrame, k: int = K) -> DataFrame:
    """Votes -> verified spans (doc_id, body, label, base, first, last, coverage)."""
    doc = ["doc_id", "body"]
    diagonals = (
        found.where("places IS NOT NULL")
        .select(*doc, "p", F.explode("places").alias("at"))
        .select(*doc, "p", "at.*", (F.col("p") - F.col("at.t")).alias("diagonal"))
        .distinct()
        .groupBy(*doc, "template", "label", "base", "size", "diagonal")
        .agg(F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("t").alias("ts"))
    )
    order = Window.partitionBy(*doc, "template").orderBy("first", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    near = (
        (F.col("first") - F.max("last").over(before) <= k + SLACK)
        & (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= SLACK)
        & ~F.col("base")
    )
    starts = diagonals.withColumn("new", F.when(near, 0).otherwise(1))
    merged = (
        starts.withColumn("span", F.sum("new").over(order))
        .groupBy(*doc, "template", "label", "base", "size", "span")
        .agg(F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + k - 1)))))
    return merged.withColumn("coverage", covered / F.col("size")).where(
        F.when(F.col("base"), F.col("coverage") == 1).otherwise(F.col("coverage") >= COVERAGE)
    )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (best share of a template's words found)."""
    found = materialize(votes(docs, id_column, text_column, k), "votes")
    doc = ["doc_id", "body"]
    ends = found.where("places IS NULL").groupBy(*doc).agg(F.count(F.lit(1)).alias("rows"), F.max("n_words").alias("n_words"))
    labels = spans(found, k).groupBy(*doc).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("coverage").alias("score"),
    )

    def text(name: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit("")).alias(name)

    return (
        ends.join(labels, ends.doc_id.eqNullSafe(labels.doc_id) & (ends.body == labels.body), "left")
        .select(
            F.explode(F.array_repeat(ends.doc_id, F.col("rows").cast("int"))).alias("doc_id"),
            "n_words",
            F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
            "first_word",
            "last_word",
            text("base_labels"),
            text("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
