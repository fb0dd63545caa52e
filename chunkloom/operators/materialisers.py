"""Materialisers that need no model: plain and joined texts, chat rows, multiple choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.templates import render
from chunkloom.plans.cuts import greedy_cuts
from chunkloom.plans.ranking import _place
from chunkloom.session import materialize

SEPARATOR = "\n\n"


def sequence_number(chunk_id: Column) -> Column:
    """The number behind the last underscore of a chunk id."""
    return F.substring_index(chunk_id, "_", -1).try_cast("bigint")


def cpt_plain(chunks: DataFrame, text_field: str = "text") -> DataFrame:
    """One row of plain text for each chunk, under the field name asked for."""
    return chunks.select("chunk_id", F.col("text").alias(text_field))


def cpt_concat(
    chunks: DataFrame, max_doc_tokens: int, *, separator: str = SEPARATOR, text_field: str = "text", by: str = "source_id"
) -> DataFrame:
    """Long documents of consecutive chunks of a source: (``by``, doc, n_chunks, token_count, text).

    Chunks are taken in the order of source and number until the next would pass ``max_doc_tokens``; a larger chunk is a
    document of its own, and separators are not counted.  Chunk ids are unique, as in the table.  Null texts are empty ones;
    chunks without a source are one source.  Only ids and sizes are ranked; each text is shuffled to its id and to its document.
    """
    ids = chunks.select(
        F.struct(F.col(by).alias("id")).alias("source"), "source_id", sequence_number(F.col("chunk_id")).alias("seq"), "chunk_id", "token_count"
    )
    cut = greedy_cuts(ids, ["source"], ["source_id", "seq", "chunk_id"], "token_count", max_doc_tokens)
    texts = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = cut.join(texts, "chunk_id")
    joined = parts.groupBy("source", "cut").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("token_count"),
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], separator).alias(text_field),
    )
    return joined.select(F.col("source.id").alias(by), F.col("cut").alias("doc"), "n_chunks", "token_count", text_field)


def sft_from_chunks(chunks: DataFrame, user_prompt: str, system_prompt: str | None = None) -> DataFrame:
    """Chat rows (chunk_id, messages as JSON): the chunk answers a prompt made from its columns.

    ``{column}`` in ``user_prompt`` stands for a column, ``{chunk_text}`` for the text.
    """
    named = chunks.withColumn("chunk_text", F.coalesce("text", F.lit("")))
    said = [("user", render(user_prompt, {c: F.col(f"`{c}`") for c in named.columns})), ("assistant", F.col("chunk_text"))]
    if system_prompt is not None:
        said.insert(0, ("system", F.lit(system_prompt)))
    messages = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content")) for role, text in said])
    return named.select("chunk_id", F.to_json(messages).alias("messages"))


def _ring(answers: DataFrame, k: int) -> DataFrame:
    """Answers of a group in the order of their hash, each with the ``k`` that follow, around the end to the start.

    Ranges are read by one task each; the first ``k`` of the next ranges are handed on as rows
    (at most ``k`` times the ranges), so no group is ever one task's.
    """
    placed = _place(answers, ["group", "place", "answer"], None)
    first = Window.partitionBy("group", "_part").orderBy("place", "answer")
    heads = materialize(placed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n"), "heads")
    # Around the end: the ranges of a group come once more behind its last.
    near = Window.partitionBy("group").orderBy("turn", "_part", "place", "answer")
    twice = heads.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    # Of each range: the k heads that come behind it.
    listed = twice.withColumn("_follow", F.collect_list(F.struct("place", "answer")).over(near.rowsBetween(1, k)))
    ends = listed.where("turn = 0").groupBy("group", "_part").agg(F.max_by("_follow", F.struct("place", "answer")).alias("_after"))
    own = Window.partitionBy("group", "_part").orderBy("place", "answer")
    followed = placed.withColumn("_own", F.collect_list("answer").over(own.rowsBetween(1, k)))
    return followed.join(ends, ["group", "_part"]).select(
        "group", "answer", F.slice(F.concat("_own", F.col("_after.answer")), 1, k).alias("next")
    )


def multiple_choice(questions: DataFrame, distractors: int = 3, *, group: str = "group", seed: int = 42) -> DataFrame:
    """(id, question, options, answer_at): the answer among ``distractors`` others of its group.

    ``questions(id, question, answer, group)``.  The distinct answers of a group form a ring in the order of
    their hash; the distractors are the next ones on it, so they are never the answer itself, differ from each
    other, and do not depend on partitioning.  The options are ordered by a digest of id and option.  Groups with too few
    distinct answers give shorter lists; rows without an answer give none.
    """
    if distractors < 1:
        raise ValueError("at least one distractor")
    asked = questions.where("answer IS NOT NULL").select(
        "id", "question", "answer", F.struct(F.col(group).alias("name")).alias("group")
    )
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col("answer")))
    answers = asked.select("group", "answer").distinct().withColumn("place", place)
    ring = _ring(answers, distractors)
    # The ring may come round to the answer, and to others twice.
    others = F.array_distinct(F.array_remove(F.col("next"), F.col("answer")))
    drawn = asked.join(materialize(ring.withColumn("others", others).drop("next"), "ring"), ["group", "answer"])
    key = lambda option: F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(":"), option))
    shuffled = F.sort_array(F.transform(F.concat(F.array("answer"), "others"), lambda o: F.struct(key(o).alias("k"), o.alias("o"))))
    return drawn.withColumn("options", shuffled["o"]).select(
        "id", "question", "options", (F.array_position("options", F.col("answer")) - 1).cast("int").alias("answer_at")
    )
