import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions.hashing import md5_mod
from chunkloom.functions.jsonx import object_field, rewrite_arrows
from chunkloom.functions.templates import TemplateError, render
from chunkloom.functions.text import clamp_unit, first_non_blank, prefix, shingles, strip, words
from chunkloom.operators.synthesis import split_of
from chunkloom.schema import config_hash

TEXTS = st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00\x1c\x1d\x1e\x1f"), max_size=40), min_size=1, max_size=30)
QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return df.select(*exprs).orderBy("i").collect()


@QUIET
@given(TEXTS)
def test_text_functions_equal_python(spark, texts):
    rows = column(spark, texts, "i", words(F.col("s")).alias("w"), strip(F.col("s")).alias("t"), prefix(F.col("s"), 7).alias("p"))
    for text, row in zip(texts, rows):
        assert row.t == text.strip()
        assert row.p == text[:7]
        assert len(row.w) == len(text.split())


@QUIET
@given(TEXTS)
def test_md5_mod_equals_python(spark, texts):
    rows = column(spark, texts, "i", md5_mod(F.col("s"), 100).alias("m"), split_of(F.col("s"), 0.29).alias("split"))
    for text, row in zip(texts, rows):
        want = int(hashlib.md5(text.encode()).hexdigest(), 16) % 100
        assert row.m == want
        assert row.split == ("validation" if want < 28 else "train")


def test_shingles(spark):
    rows = column(spark, ["A b  C\nd", "a b", "", "x y z"], "i", shingles(F.col("s")).alias("g"))
    assert [r.g for r in rows] == [["a b c", "b c d"], [], [], ["x y z"]]


def test_first_non_blank_and_clamp(spark):
    row = spark.range(1).select(
        first_non_blank(F.lit(" 　"), F.lit(None).cast("string"), F.lit(" x ")).alias("a"),
        *[clamp_unit(F.lit(v)).alias(f"c{i}") for i, v in enumerate([-1.0, 0.3, 7.0])],
    ).first()
    assert tuple(row) == ("x", 0.0, 0.3, 1.0)


def test_object_field(spark):
    texts = ['{"instruction": "a", "output": 5}', "0.5", "[1]", "nope", '{"instruction": null, "output": true}', '{"x": 1}']
    rows = column(spark, texts, "i", object_field(F.col("s"), "instruction").alias("a"), object_field(F.col("s"), "output").alias("b"))
    assert [(r.a, r.b) for r in rows] == [("a", "5"), (None, None), (None, None), (None, None), ("None", "True"), (None, None)]


def test_arrows_leave_literals_alone(spark):
    assert rewrite_arrows("x = 'a->>''b'''") == "x = 'a->>''b'''"
    df = spark.createDataFrame([(json.dumps({"page": 3, "a.b": "q"}),)], "refs string")
    assert df.where(rewrite_arrows("refs->>'page' = '3' AND refs ->> 'a.b' = 'q'")).count() == 1


def test_render(spark):
    df = spark.createDataFrame([("t", None)], "text string, n int")
    fields = {"text": F.col("text"), "n": F.col("n")}
    assert df.select(render('{{"q": "{text}"}} {n}', fields)).first()[0] == '{"q": "t"} None'
    with pytest.raises(TemplateError, match="no column 'other'"):
        render("{other}", fields)


def test_config_hash_is_canonical():
    assert config_hash({}) == hashlib.sha256(b"{}").hexdigest()
    assert config_hash({"b": 1, "a": 2}) == config_hash({"a": 2, "b": 1})


def test_split_is_complete_and_near_the_ratio(spark):
    ids = spark.range(1000).select(F.format_string("chunk_%05d", "id").alias("chunk_id"))
    share = ids.where(split_of(F.col("chunk_id"), 0.1) == "validation").count()
    assert 70 <= share <= 130
    assert ids.where(split_of(F.col("chunk_id"), 0.0) == "train").count() == 1000
    assert ids.where(split_of(F.col("chunk_id"), 1.0) == "validation").count() == 1000
