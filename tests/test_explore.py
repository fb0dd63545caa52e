import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.plans import explore
from chunkloom.plans.filters import QueryError, where
from chunkloom.schema import CHUNK_SCHEMA, conform


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("1_0", 1, "it's", 10, 0.8, "en", '{"page": 1}'), ("1_1", 1, "b", 20, 0.9, None, ""),
            ("2_0", 2, "c", 30, 0.5, "de", '{"page": 2}'), ("2_1", 2, "d", 40, 0.7, None, "")]
    return conform(spark.createDataFrame(rows, "chunk_id string, source_id bigint, text string, token_count int, attr_quality_score float, attr_lang_code string, source_refs string"))


def test_predicates(chunks):
    ids = lambda p: sorted(r.chunk_id for r in where(chunks, p).collect())
    assert len(ids(None)) == len(ids("")) == 4
    assert ids("text = 'it''s'") == ["1_0"]
    assert ids("source_refs->>'page' = '2'") == ["2_0"]
    assert ids("token_count BETWEEN 20 AND 30 AND NOT source_id IN (2)") == ["1_1"]
    assert ids("length(text) > 1 OR upper(text) LIKE 'D'") == ["1_0", "2_1"]
    assert ids("text = 'x (select y)'") == []


@pytest.mark.parametrize("bad", ["nope = 1", "a b c (", "x" * 1001, "source_id IN (SELECT 1)", "EXISTS ( select 1)", "row_number() OVER (ORDER BY text) = 1"])
def test_refused_predicates(chunks, bad):
    with pytest.raises(QueryError):
        where(chunks, bad).collect()


def test_page_and_projection(chunks):
    page = explore.query(chunks, "source_id > 0", ["token_count"], limit=2, offset=1).collect()
    assert [(r.chunk_id, r.token_count, r.text) for r in page] == [("1_1", 20, None), ("2_0", 30, None)]
    assert page[0].asDict().keys() == {f.name for f in CHUNK_SCHEMA}
    assert len(explore.query(chunks).collect()) == 4
    assert explore.total(chunks, "source_id = 1").first().total == 2
    for kwargs in ({"limit": 0}, {"limit": 1001}, {"offset": -1}, {"columns": ["nope"]}):
        with pytest.raises(QueryError):
            explore.query(chunks, **kwargs)


def test_lookup_binds_the_id(chunks):
    assert explore.lookup(chunks, "1_1").first().text == "b"
    assert explore.lookup(chunks, "x' OR '1'='1").count() == 0


def test_aggregate(chunks):
    rows = {r.source_id: r for r in explore.aggregate(chunks, "source_id", ["count", "sum:attr_quality_score", "mean:token_count", "max:text"]).collect()}
    assert rows[1]["count"] == 2 and rows[1]["sum_attr_quality_score"] == pytest.approx(1.7)
    assert rows[2]["mean_token_count"] == 35.0 and rows[2]["max_text"] == "d"
    nulls = {r.attr_lang_code: r["count"] for r in explore.aggregate(chunks, "attr_lang_code", ["count"]).collect()}
    assert nulls == {"en": 1, "de": 1, None: 2}


@pytest.mark.parametrize("metric", ["median:x", "sum", "sum:", "count:x:y", "avg:token_count", "sum:nope"])
def test_bad_metrics(chunks, metric):
    with pytest.raises(QueryError):
        explore.aggregate(chunks, "source_id", [metric])


def test_metric_bounds(chunks):
    for metrics in ([], ["count"] * 21):
        with pytest.raises(QueryError):
            explore.aggregate(chunks, "source_id", metrics)


@pytest.mark.parametrize("bins", [1, 3, 10, 97])
@pytest.mark.parametrize("kind", ["uniform", "integers", "tenths"])
def test_histogram_equals_numpy(spark, bins, kind):
    rng = random.Random(bins)
    values = {"uniform": [rng.random() for _ in range(500)], "integers": [float(rng.randrange(50)) for _ in range(500)],
              "tenths": [i / 10 for i in range(200)]}[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    rows = explore.numeric_distribution(df, "x", bins).orderBy("bucket").collect()
    counts, edges = np.histogram(np.array(values), bins=bins)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r.lower for r in rows] + [rows[-1].upper] == pytest.approx(edges.tolist(), rel=1e-12)


def test_distribution_edges(spark, chunks):
    nothing = chunks.withColumn("attr_quality_score", F.lit(None).cast("float"))
    assert explore.distribution(nothing, "attr_quality_score").collect() == []
    one = explore.distribution(chunks.withColumn("token_count", F.lit(7)), "token_count").collect()
    assert [(r.lower, r.upper, r["count"]) for r in one] == [(7.0, 7.0, 4)]
    langs = explore.distribution(chunks, "attr_lang_code").collect()
    assert [(r.value, r["count"]) for r in langs] == [(None, 2), ("de", 1), ("en", 1)]
    assert explore.distribution(chunks, "text", predicate="source_id = 99").collect() == []
    for column in ("created_at", "attr_minhash_is_head", "attr_pii_categories", "nope"):
        with pytest.raises(QueryError):
            explore.distribution(chunks, column)
    with pytest.raises(QueryError):
        explore.numeric_distribution(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"), "x")


def test_filter_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = explore.aggregate(df, "l_returnflag", ["sum:l_quantity"], "l_orderkey > 10")._jdf.queryExecution().toString()
    assert "GreaterThan(l_orderkey,10)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


@pytest.mark.parametrize(
    "predicate",
    [
        "token_count IN (/**/ SELECT id FROM range(3))",
        "EXISTS (/* */SELECT 1)",
        "EXISTS(SELECT 1)",
        "token_count IN (TABLE x)",
        "reflect('java.lang.System', 'getProperty', 'user.home') IS NULL",
        "java_method('java.lang.System', 'getProperty', 'user.home') = ''",
        "`reflect`('java.lang.System', 'getProperty', 'x') IS NULL",
        "r'\\' OR reflect('java.lang.System', 'x') = '' OR '' = ''",
        "text = 'a\\\\' OR reflect('java.lang.System', 'x') = ''",
        "row_number() OVER (ORDER BY text) = 1",
        "explode(array(1)) = 1",
        "raise_error('x') IS NULL",
        "text = 'x' -- rest",
    ],
)
def test_predicates_call_known_functions_only(spark, predicate):
    rows = spark.createDataFrame([("a", 1)], "text string, token_count int")
    with pytest.raises(QueryError):
        where(rows, predicate).collect()


@pytest.mark.parametrize(
    "predicate",
    [
        "text = 'select (x) -- from /* table */ reflect(1)'",
        "text = 'it\\'s (select 1)' OR (token_count IN (1, 2) AND NOT (text IS NULL))",
        "length(text) BETWEEN (0) AND (5) AND lower(text) LIKE ('%')",
        "array_contains(split(text, ','), 'a') OR text RLIKE ('b')",
        "`text` IN ('a') AND (CASE WHEN (token_count > 0) THEN (1) ELSE (2) END) = 1",
        "token_count IS DISTINCT FROM (7) AND CAST(token_count AS double) >= 1e0",
    ],
)
def test_harmless_predicates_run(spark, predicate):
    rows = spark.createDataFrame([("a", 1)], "text string, token_count int")
    assert where(rows, predicate).count() <= 1


@pytest.mark.parametrize(
    "predicate",
    [
        "token_count IN (FROM parquet.`{path}`)",
        "(FROM v) = token_count",
        "token_count = (FROM parquet.`{path}` |> SELECT token_count)",
        "abs(token_count) FILTER (WHERE EXISTS (FROM v)) = 1",
        "array_contains(transform(array(1), x -> x), 1)",
        "count(*) = 1",
        "* = 1",
        "token_count = :x",
        "IDENTIFIER('token_count') = 1",
        "repeat('x', 2000000000) = text",
        "repeat('x', token_count) = text",
        "lpad(text, 10001, 'x') = ''",
        "repeat(repeat('x', 1000), 1000) = text",
        "replace(replace(text, 'a', 'aaaa'), 'a', 'aaaa') = ''",
        f"replace(text, 'a', '{'a' * 101}') = ''",
        "replace(text, 'a', text) = ''",
        "regexp_replace(text, 'a', concat(text, text)) = ''",
    ],
)
def test_predicates_read_no_other_table_and_make_no_long_texts(spark, folder, predicate):
    rows = spark.createDataFrame([("a", 1)], "text string, token_count int")
    rows.select("token_count").write.parquet(folder)
    rows.createOrReplaceTempView("v")
    with pytest.raises(QueryError):
        where(rows, predicate.replace("{path}", folder)).collect()


def test_a_refused_predicate_looks_at_no_file(spark):
    rows = spark.createDataFrame([("a", 1)], "text string, token_count int")
    with pytest.raises(QueryError, match="InSubquery"):
        where(rows, "token_count IN (FROM parquet.`/there/is/no/such/path`)")


def test_bounded_texts_run(spark):
    rows = spark.createDataFrame([("a", 1)], "text string, token_count int")
    for predicate in ("lpad(text, 3, '-') = '--a'", "repeat(text, 2) = 'aa'", "replace(text, 'a', 'b') = 'b'", "regexp_replace(text, '^a', 'bb') = 'bb'", "replace(text, 'a') = ''"):
        assert where(rows, predicate).count() == 1
