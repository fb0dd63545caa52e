"""Language tagging: (code, confidence) per chunk.

Two detectors: stop-word shares (plain Columns) and a hashed character 3-gram
model trained by one aggregation over labelled text.  Any other detector can
be plugged in as a batch function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import clamp_unit, strip, words

# Fixed value: the answer for blank text and for failures.
UNDETERMINED = ("und", 0.0)

# Frequent function words that tell these languages apart.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "auf", "für", "von", "zu", "den", "sich"),
    "en": ("the", "and", "of", "to", "is", "that", "for", "with", "was", "this", "are", "by", "it", "from", "have"),
    "es": ("el", "los", "las", "que", "del", "por", "con", "una", "para", "como", "se", "su", "más", "y", "lo"),
    "fr": ("le", "les", "des", "et", "est", "dans", "pour", "pas", "une", "du", "au", "avec", "qui", "sur", "par"),
}


def _answer(code: Column, confidence: Column) -> tuple[Column, Column]:
    known = code.isNotNull() & (confidence > 0)
    return (
        F.when(known, code).otherwise(UNDETERMINED[0]).alias("attr_lang_code"),
        F.when(known, clamp_unit(confidence))
        .otherwise(UNDETERMINED[1])
        .cast("float")
        .alias("attr_lang_confidence"),
    )


def add_language_by_stop_words(
    rows: DataFrame, stop_words: dict[str, tuple[str, ...]] = STOP_WORDS
) -> DataFrame:
    """The rows with the language that has most stop words; its share of all hits is the
    confidence.  Ties go to the alphabetically first code.  Narrow: no shuffle.
    """
    kept = [c for c in rows.columns if c not in ("attr_lang_code", "attr_lang_confidence")]
    listed = rows.select(*kept, words(F.col("text")).alias("_words"))

    def hits(stops: tuple[str, ...]) -> Column:
        return F.size(F.filter("_words", lambda w: w.isin(*stops)))

    codes = sorted(stop_words)
    counted = listed.select(*kept, *[hits(stop_words[c]).alias(f"_n_{c}") for c in codes])
    total = sum((F.col(f"_n_{c}") for c in codes), F.lit(0))
    best = F.greatest(*[F.col(f"_n_{c}") for c in codes])
    code = F.coalesce(*[F.when(F.col(f"_n_{c}") == best, F.lit(c)) for c in codes])
    share = F.when(total > 0, best / total)
    return counted.select(*kept, *_answer(code, share))


def tag_language_by_stop_words(
    chunks: DataFrame, stop_words: dict[str, tuple[str, ...]] = STOP_WORDS
) -> DataFrame:
    """(chunk_id, source_id, attr_lang_code, attr_lang_confidence)."""
    return add_language_by_stop_words(chunks.select("chunk_id", "source_id", "text"), stop_words).drop("text")


def tag_language(
    chunks: DataFrame, make_detector: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]
) -> DataFrame:
    """Run a batch detector, made once per task.

    Blank texts are not asked about; a text the detector fails on alone is
    undetermined, the others of its batch keep their answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = make_detector()

        def one(text: str) -> tuple[str, float]:
            try:
                return detect([text])[0]
            except Exception:
                return UNDETERMINED

        for batch in batches:
            texts = batch.column(2).to_pylist()
            try:
                answers = list(detect(texts))
                if len(answers) != len(texts):
                    raise ValueError("the detector returned another number of answers")
            except Exception:
                answers = [one(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([a[0] for a in answers], pa.string()),
                    pa.array([float(a[1]) for a in answers], pa.float64()),
                ],
                names=["chunk_id", "source_id", "code", "score"],
            )

    blank = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    asked = (
        chunks.where(~blank)
        .select("chunk_id", "source_id", "text")
        .mapInArrow(run, "chunk_id string, source_id bigint, code string, score double")
    )
    answered = asked.select(
        "chunk_id",
        "source_id",
        F.col("code").alias("attr_lang_code"),
        clamp_unit(F.col("score")).cast("float").alias("attr_lang_confidence"),
    )
    silent = chunks.where(blank).select(
        "chunk_id",
        "source_id",
        F.lit(UNDETERMINED[0]).alias("attr_lang_code"),
        F.lit(UNDETERMINED[1]).cast("float").alias("attr_lang_confidence"),
    )
    return answered.unionByName(silent)


class NgramModel:
    """Naive Bayes over hashed character 3-grams, lower-cased.

    The table has ``buckets`` numbers per language whatever the corpus, so it
    travels with the task.
    """

    def __init__(self, codes: list[str], log_likelihood: np.ndarray) -> None:
        self.codes = codes
        self.log_likelihood = log_likelihood  # (languages, buckets)

    BUCKETS = 1 << 14
    MULTIPLIER = 257

    @classmethod
    def grams(cls, text: str) -> np.ndarray:
        """The bucket of each 3-gram of one text."""
        cp = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4").astype(np.int64)
        m = cls.MULTIPLIER
        return ((cp[:-2] * m + cp[1:-1]) * m + cp[2:]) % cls.BUCKETS

    @classmethod
    def bucket_counts(cls, text: str) -> np.ndarray:
        """Number of 3-grams per bucket of one text."""
        return np.bincount(cls.grams(text), minlength=cls.BUCKETS)

    @classmethod
    def train(cls, labelled: DataFrame) -> NgramModel:
        """From ``labelled(text, lang)``: one map-side combined aggregation to
        at most languages x buckets rows."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for text, lang in zip(batch["text"], batch["lang"]):
                    found = cls.bucket_counts(text)
                    sums[lang] = sums[lang] + found if lang in sums else found
            for lang, found in sums.items():
                at = np.flatnonzero(found)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": found[at]})

        rows = (
            labelled.select("text", "lang")
            .where("text IS NOT NULL AND lang IS NOT NULL")
            .mapInPandas(count, "lang string, bucket bigint, n bigint")
            .groupBy("lang", "bucket")
            .agg(F.sum("n").alias("n"))
            .toPandas()
        )
        codes = sorted(rows["lang"].unique())
        counts = np.ones((len(codes), cls.BUCKETS))  # add-one smoothing
        where = rows["lang"].map({c: i for i, c in enumerate(codes)}).to_numpy()
        np.add.at(counts, (where, rows["bucket"].to_numpy()), rows["n"].to_numpy())
        return cls(codes, np.log(counts / counts.sum(axis=1, keepdims=True)))

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        """Best language and its posterior probability; no 3-gram, no answer."""
        out = []
        for text in texts:
            buckets, counts = np.unique(self.grams(text), return_counts=True)
            if not len(buckets):
                out.append(UNDETERMINED)
                continue
            score = self.log_likelihood[:, buckets] @ counts
            weight = np.exp(score - score.max())
            best = int(score.argmax())
            out.append((self.codes[best], float(weight[best] / weight.sum())))
        return out
