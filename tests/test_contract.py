"""Operator contract: checks before the job, errors, the ledger."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.operators import augment
from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.operators.contract import ConfigError, Ledger, Operator, OutputError, UnavailableError, checked_config, run_operator
from chunkloom.schema import CHUNK_SCHEMA
from chunkloom.sources.chunk_table import ChunkTable

CONFIG = {
    "share": {"type": "number", "minimum": 0, "maximum": 1, "default": 0.5},
    "mode": {"type": "string", "enum": ["a", "b"], "default": "a"},
    "words": {"type": "integer"},
}
TAGS = T.StructType().add("chunk_id", "string").add("attr_long", "boolean")


def tagger(process, **options):
    return Operator("long", "1", "tagger", {"words": {"type": "integer"}}, TAGS, process, **options)


def long(chunks, config):
    return chunks.select("chunk_id", (F.col("token_count") > config["words"]).alias("attr_long"))


@pytest.fixture
def stored(spark, folder):
    table = ChunkTable(spark, folder, buckets=3)
    docs = spark.createDataFrame([(i, 1, "w " * i) for i in range(1, 10)], "source_id long, source_collection_id long, text string")
    table.replace_rows(fixed_size_chunks(docs))
    return table, Ledger(spark, folder + "-ledger"), docs.selectExpr("source_id AS id")


def test_config():
    operator = Operator("x", "1", "tagger", CONFIG, TAGS, long)
    assert checked_config(operator, {"words": 3}) == {"share": 0.5, "mode": "a", "words": 3}
    for bad in ({}, {"words": "3"}, {"words": True}, {"words": 1, "mode": "c"}, {"words": 1, "share": 2}, {"words": 1, "other": 1}):
        with pytest.raises(ConfigError) as error:
            checked_config(operator, bad)
        assert not error.value.retryable


def test_errors_come_before_any_row_is_read(spark, stored):
    table, ledger, ids = stored

    def explode_when_run(chunks, config):
        return chunks.select("chunk_id", F.raise_error(F.lit("read")).cast("string").alias("attr_long"))

    with pytest.raises(OutputError):
        run_operator(tagger(explode_when_run), table, ledger, {"words": 1}, ids)
    with pytest.raises(UnavailableError) as error:
        run_operator(tagger(long, health_check=lambda: False), table, ledger, {"words": 1}, ids)
    assert error.value.retryable
    with pytest.raises(ConfigError):
        run_operator(tagger(long), table, ledger, {}, ids)
    assert run_operator(tagger(long), table, ledger, {"words": 4}, ids) == 9


def test_runs_again_skip_what_is_done(spark, stored):
    table, ledger, ids = stored
    seen = []

    def noted(chunks, config):
        seen.append(sorted(r.source_id for r in chunks.select("source_id").distinct().collect()))
        return long(chunks, config)

    assert run_operator(tagger(noted), table, ledger, {"words": 4}, ids.where("id < 4")) == 3
    assert run_operator(tagger(noted), table, ledger, {"words": 4}, ids.union(ids)) == 6
    assert run_operator(tagger(noted), table, ledger, {"words": 4}, ids) == 0
    assert seen == [[1, 2, 3], [4, 5, 6, 7, 8, 9]]
    assert {r.source_id: r.attr_long for r in table.read().collect()} == {i: i > 4 for i in range(1, 10)}
    # New chunks, another setting and another version are work again.
    ledger.forget(spark.createDataFrame([(5,), (77,)], "source_id long"))
    assert run_operator(tagger(noted), table, ledger, {"words": 4}, ids) == 1
    assert run_operator(tagger(noted), table, ledger, {"words": 5}, ids.where("id = 5")) == 1
    newer = Operator("long", "2", "tagger", {"words": {"type": "integer"}}, TAGS, noted)
    assert run_operator(newer, table, ledger, {"words": 4}, ids.where("id = 5")) == 1


def test_a_failed_run_notes_nothing(spark, stored):
    table, ledger, ids = stored

    def failing(chunks, config):
        return chunks.select("chunk_id", F.raise_error(F.lit("broken")).cast("boolean").alias("attr_long"))

    with pytest.raises(Exception, match="broken"):
        run_operator(tagger(failing), table, ledger, {"words": 1}, ids)
    assert run_operator(tagger(long), table, ledger, {"words": 1}, ids) == 9


def test_augmenters(spark, stored):
    table, ledger, ids = stored
    swap = augment.script({"w": "v"})
    operator = Operator(swap.name, "1", "augmenter", {}, CHUNK_SCHEMA, lambda chunks, config: augment.augment(chunks, swap))
    assert [run_operator(operator, table, ledger, {}, ids) for _ in range(2)] == [9, 0]
    assert table.read().where("augmented_from IS NOT NULL").count() == 9


def long_by_row(config):
    return {"attr_long": F.col("token_count") > config["words"]}


@pytest.mark.parametrize("at_once", [500_000, 2, 1])
def test_a_tagger_by_row_moves_no_row(spark, stored, monkeypatch, at_once):
    from chunkloom.schema import CHUNKS_ASSET
    from chunkloom.sources import chunk_table

    monkeypatch.setattr(chunk_table, "IDS_AT_ONCE", at_once)
    table, ledger, ids = stored
    table.replace_rows(table.read().withColumn("producer_asset", F.lit("other")).withColumn("chunk_id", F.concat("chunk_id", F.lit("_o"))))
    operator = Operator("long", "1", "tagger", {"words": {"type": "integer"}}, TAGS, columns=long_by_row)

    def tags():
        return {r.source_id: r.attr_long for r in table.read().where("producer_asset = 'chunks'").collect()}

    assert run_operator(operator, table, ledger, {"words": 4}, ids.where("id < 4").union(ids.where("id < 3"))) == 3
    assert tags() == {i: False if i < 4 else None for i in range(1, 10)}
    assert run_operator(operator, table, ledger, {"words": 4}, ids) == 6
    assert run_operator(operator, table, ledger, {"words": 4}, ids) == 0
    assert tags() == {i: i > 4 for i in range(1, 10)}
    assert run_operator(operator, table, ledger, {"words": 6}, ids.where("id > 5").union(spark.range(77, 78))) == 5
    assert tags() == {i: i > 6 if i > 5 else i > 4 for i in range(1, 10)}
    assert table.read().count() == 18 and table.read().where("attr_long IS NOT NULL").count() == 9
    # Exchanges only bring the ids together and broadcast them.
    rows = table.with_columns(long_by_row({"words": 1}), [CHUNKS_ASSET], ids)
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    wrong = Operator("long", "1", "tagger", {}, TAGS, columns=lambda config: {"attr_long": F.col("token_count")})
    with pytest.raises(OutputError):
        run_operator(wrong, table, ledger, {}, ids)
