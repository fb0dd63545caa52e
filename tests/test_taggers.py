import pytest
from pyspark.sql import functions as F

from chunkloom.operators import language, quality
from chunkloom.operators.models import Completion, MockModel, complete
from chunkloom.schema import conform


def chunks(spark, texts):
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "chunk_id string, source_id bigint, text string")
    return conform(df.withColumn("token_count", F.lit(256)))


class Scripted:
    """Answers with the text after the prompt's marker; fails on request."""

    def complete(self, prompts, max_tokens):
        assert max_tokens == 16
        return [self.one(p.split("Text:\n")[1].split("\n\nRespond")[0]) for p in prompts]

    def one(self, text):
        return Completion(error="refused") if text == "fail" else Completion(text, "m")


class Down:
    def complete(self, prompts, max_tokens):
        raise ConnectionError("down")


def test_quality_answers(spark):
    answers = ["0.7", " 1.5\n", "-3", "good", "", "fail", "nan", "0.5f", "1e-1", "inf"]
    got = quality.tag_quality(chunks(spark, answers), Scripted).orderBy(F.col("chunk_id").cast("int")).collect()
    scores = [(round(r.attr_quality_score, 4), r.attr_quality_provider) for r in got]
    assert scores == [(0.7, "m"), (1.0, "m"), (0.0, "m"), (0.0, "error"), (0.0, "error"), (0.0, "error"), (1.0, "m"), (0.0, "error"), (0.1, "m"), (1.0, "m")]


def test_quality_mock_and_outage(spark):
    df = chunks(spark, ["a", "b"])
    assert {(r.attr_quality_score, r.attr_quality_provider) for r in quality.tag_quality(df).collect()} == {(0.5, "mock")}
    assert {(r.attr_quality_score, r.attr_quality_provider) for r in quality.tag_quality(df, Down).collect()} == {(0.0, "error")}
    row = quality.tag_quality_by_length(df).first()
    assert (row.attr_quality_score, row.attr_quality_provider) == (0.5, "length_heuristic")


def test_model_answers_keep_their_rows(spark):
    df = spark.range(50).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    got = complete(df, MockModel).collect()
    assert {r.id for r in got} == set(range(50)) and {r.content for r in got} == {"0.5"}
    big = spark.createDataFrame([(2**60 + 1, "p", [1, 2]), (None, "q", None)], "id bigint, prompt string, tags array<int>")
    assert {(r.id, tuple(r.tags or ())) for r in complete(big).collect()} == {(2**60 + 1, (1, 2)), (None, ())}


class Detector:
    def __call__(self, texts):
        return [self.one(t) for t in texts]

    def one(self, text):
        if "boom" in text:
            raise RuntimeError("boom")
        return ("en", 1.7) if "hello" in text else ("fr", -0.2)


def test_language_contract(spark):
    got = language.tag_language(chunks(spark, ["hello", "boom", "salut", "", " \n", None]), Detector).orderBy("chunk_id").collect()
    assert [(r.attr_lang_code, r.attr_lang_confidence) for r in got] == [("en", 1.0), ("und", 0.0), ("fr", 0.0), ("und", 0.0), ("und", 0.0), ("und", 0.0)]


def test_stop_words(spark):
    got = language.tag_language_by_stop_words(chunks(spark, ["the cat and the dog", "der Hund und die Katze", "xyz", "", None, "The par"])).orderBy("chunk_id").collect()
    assert [(r.attr_lang_code, round(r.attr_lang_confidence, 3)) for r in got] == [("en", 1.0), ("de", 1.0), ("und", 0.0), ("und", 0.0), ("und", 0.0), ("en", 0.5)]


def test_trained_model_knows_the_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 200")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language.NgramModel.train(train)
    assert model.codes == ["de", "en", "es", "fr"]
    rows = test.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("source_id"), "text", "lang")
    got = language.tag_language(rows, lambda: model).join(rows, "chunk_id")
    right = got.where("lang = attr_lang_code").count() / got.count()
    assert right > 0.9
    assert model(["ab"]) == [("und", 0.0)]


@pytest.mark.parametrize("text, want", [("abc", 1), ("abcd", 2), ("", 0), ("éàü", 1)])
def test_gram_counts(text, want):
    assert language.NgramModel.bucket_counts(text).sum() == want


class RaisingModel:
    """Raises for a whole batch if one prompt is bad."""

    def complete(self, prompts, max_tokens):
        if "bad" in prompts:
            raise RuntimeError("refused")
        return [Completion(p.upper()) for p in prompts]


@pytest.mark.parametrize("size", [1, 5, 10_000])
def test_one_raising_prompt_costs_one_row(spark, size):
    rows = spark.createDataFrame([(i, "bad" if i == 17 else f"p{i}") for i in range(40)], "id int, prompt string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, size)
    try:
        got = complete(rows, RaisingModel).collect()
    finally:
        spark.conf.unset(key)
    assert [(r.id, r.error) for r in got if r.error] == [(17, "RuntimeError: refused")]
    assert all(r.content == f"P{r.id}" for r in got if r.id != 17)


def test_a_failing_prompt_costs_halves():
    from chunkloom.operators.models import Completion, _ask

    calls = []

    class Fails:
        def complete(self, prompts, max_tokens):
            calls.append(len(prompts))
            if "bad" in prompts:
                raise RuntimeError("bad")
            return [Completion(p) for p in prompts]

    prompts = [f"p{i}" for i in range(1000)]
    prompts[321] = "bad"
    answers = _ask(Fails(), prompts, 1)
    assert [a.content for a in answers] == [None if p == "bad" else p for p in prompts]
    assert answers[321].error and len(calls) < 25
