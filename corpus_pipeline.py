"""A training corpus in five stages: quality, language, near-duplicates, benchmark
passages, packing.

Each stage takes (spark, docs, sf_dir) and gets what the one before has left; all
but the last return the columns of ``documents``, so a stage's decisions are
the rows it keeps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import decontam, langid, near_texts, packing, pu_quality
from chunkloom.llm.common import fold, unused
from chunkloom.session import materialize, tune

# A text nearer than this to no language is rejected, as is one nearer to none than this share
# of what the learned texts score in the median: well above the scatter of unrelated texts.
# Texts of fewer characters than SHORT have too few n-grams for that and need the first only.
LEAST_COSINE = 0.05
SHARE_OF_MEDIAN = 0.2
SHORT = 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; labels of one fold in five are not learned."""
    score = pu_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold(F.col("doc_id"), 5, 0))
    return docs.where(score("text") >= pu_quality.THRESHOLD)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that resemble some language; one fold in three is not learned from."""
    learned = ~fold(F.col("doc_id"), 3, 1)
    predict = langid.predictor(langid.learn(docs.where(learned)))
    name = unused(docs, "answer")
    scored = materialize(docs.withColumn(name, predict("text")), "languages")
    answer = scored[name]
    taught = scored.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull())
    median = taught.agg(F.percentile_approx(answer["score"], 0.5, 1000)).first()[0]
    least = F.when(F.length("text") < SHORT, LEAST_COSINE).otherwise(max(LEAST_COSINE, SHARE_OF_MEDIAN * (median or 0)))
    return scored.where((answer["lang_pred"] != langid.UNKNOWN) & (answer["score"] >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, proposed by fingerprints and compared by five-word shingles: that with the smallest id."""
    return near_texts.first_of_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

# Classifier, fingerprints and tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
