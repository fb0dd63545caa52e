import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chunkloom.operators.assets import ASSETS, original_chunks, run_tagger
from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.schema import CHUNK_COLUMNS
from chunkloom.sources.chunk_table import ChunkTable, merge_columns


def docs(spark, ids, text="one two three"):
    return spark.createDataFrame([(i, i % 2, f"{text} {i}") for i in ids], "source_id bigint, source_collection_id bigint, text string")


@pytest.fixture
def table(spark, folder):
    return ChunkTable(spark, folder, buckets=4)


def texts(table):
    return {(r.chunk_id, r.producer_asset): r.text for r in table.read().collect()}


def test_absent_table_is_empty(table):
    assert table.read().columns == CHUNK_COLUMNS and table.read().count() == 0


def test_row_mode_replaces_only_its_rows(spark, table):
    table.replace_rows(fixed_size_chunks(docs(spark, range(20))))
    table.replace_rows(fixed_size_chunks(docs(spark, range(20)), producer="other"))
    before = texts(table)
    table.replace_rows(fixed_size_chunks(docs(spark, [3, 50], "new")))
    after = texts(table)
    assert after[("3_0", "chunks")] == "new 3" and after[("50_0", "chunks")] == "new 50"
    assert {k: v for k, v in after.items() if k[0] not in ("3_0", "50_0") or k[1] == "other"} == {
        k: v for k, v in before.items() if k != ("3_0", "chunks")}
    table.replace_rows(fixed_size_chunks(docs(spark, [3, 50], "new")))
    assert texts(table) == after


def test_empty_output_keeps_old_rows_unless_told(spark, table):
    table.replace_rows(fixed_size_chunks(docs(spark, [1, 2])))
    nothing = fixed_size_chunks(docs(spark, [1])).where("false")
    table.replace_rows(nothing)
    assert len(texts(table)) == 2
    gone = spark.createDataFrame([(1, "chunks")], "source_id bigint, producer_asset string")
    table.replace_rows(nothing, replace_empty=gone)
    assert list(texts(table)) == [("2_0", "chunks")]


def test_fewer_chunks_leave_no_orphans(spark, table):
    table.replace_rows(fixed_size_chunks(docs(spark, [1]), budget=1))
    assert len(texts(table)) == 4
    table.replace_rows(fixed_size_chunks(docs(spark, [1])))
    assert list(texts(table)) == [("1_0", "chunks")]


def test_column_mode_changes_matched_cells_only(spark, table):
    table.replace_rows(fixed_size_chunks(docs(spark, range(6))).withColumn("attr_lang_code", F.lit("xx")))
    stamp = {r.chunk_id: r.updated_at for r in table.read().collect()}
    updates = spark.createDataFrame([("0_0", 0, 0.5, "m"), ("1_0", 1, None, None), ("99_0", 99, 1.0, "z"), (None, 2, 1.0, "z")],
                                    "chunk_id string, source_id bigint, attr_quality_score double, attr_quality_provider string")
    table.merge(updates)
    rows = {r.chunk_id: r for r in table.read().collect()}
    assert len(rows) == 6 and all(r.attr_lang_code == "xx" for r in rows.values())
    assert (rows["0_0"].attr_quality_score, rows["0_0"].attr_quality_provider) == (0.5, "m")
    assert rows["2_0"].attr_quality_score is None
    table.merge(spark.createDataFrame([("0_0", None)], "chunk_id string, attr_quality_score double"))
    row = {r.chunk_id: r for r in table.read().collect()}["0_0"]
    assert row.attr_quality_score is None and row.attr_quality_provider == "m"
    assert {r.chunk_id: r.updated_at for r in table.read().collect()} == stamp


def test_new_column_stays(spark, table):
    table.replace_rows(fixed_size_chunks(docs(spark, [1, 2])))
    table.merge(spark.createDataFrame([("1_0", 7)], "chunk_id string, attr_new int"))
    table.replace_rows(fixed_size_chunks(docs(spark, [3])))
    assert {r.chunk_id: r.attr_new for r in table.read().collect()} == {"1_0": 7, "2_0": None, "3_0": None}


def test_conflicting_updates_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1)], "chunk_id string, x int")
    same = spark.createDataFrame([("a", 2), ("a", 2)], "chunk_id string, x int")
    assert [tuple(r) for r in merge_columns(rows, same).collect()] == [("a", 2)]
    clash = spark.createDataFrame([("a", 2), ("a", None)], "chunk_id string, x int")
    with pytest.raises(PySparkException, match="conflicting updates for a"):
        merge_columns(rows, clash).collect()


def test_source_and_producer_prune_the_scan(spark, table):
    table.replace_rows(fixed_size_chunks(docs(spark, range(6))))
    plan = original_chunks(table.read())._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(producer_asset" in plan
    table.replace_rows(fixed_size_chunks(docs(spark, range(6, 40))))
    some = table.read(spark.createDataFrame([(3,), (3,), (99,)], "id bigint"))
    assert [r.source_id for r in some.collect()] == [3]
    plan = original_chunks(some)._jdf.queryExecution().toString()
    assert "source_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_taggers_see_originals_of_requested_sources(spark, table):
    table.replace_rows(fixed_size_chunks(docs(spark, range(4))))
    table.replace_rows(fixed_size_chunks(docs(spark, range(4)), producer="augment_x").withColumn("chunk_id", F.concat("chunk_id", F.lit("_x"))))
    run_tagger(table, "attr_quality", spark.createDataFrame([(1,), (2,)], "id bigint"))
    tagged = {r.chunk_id for r in table.read().where("attr_quality_provider = 'mock'").collect()}
    assert tagged == {"1_0", "2_0"}
    run_tagger(table, "attr_minhash")
    assert table.read().where("attr_minhash_is_head AND producer_asset = 'chunks'").count() == 4
    assert table.read().where("attr_minhash_is_head IS NULL").count() == 4
    assert ASSETS["chunks"].mode == "row"
    with pytest.raises(ValueError):
        run_tagger(table, "chunks")


def test_scratch_tables_are_removed(spark, table):
    import os

    from chunkloom.session import materialize, scratch_tables, shared_dir

    def left():
        return {n for n in os.listdir(shared_dir(spark)) if n.split("-")[0] in ("rows", "updates", "step", "signatures", "bands", "ranges")}

    before = left()
    table.replace_rows(fixed_size_chunks(docs(spark, range(6))))
    table.replace_rows(fixed_size_chunks(docs(spark, range(3))))
    run_tagger(table, "attr_minhash")
    with scratch_tables(spark):
        assert materialize(spark.range(5)).count() == 5
    assert left() == before
    kept = materialize(spark.range(5))
    assert kept.count() == 5 and len(left()) == len(before) + 1


def test_bucket_count_belongs_to_the_table(spark, folder):
    ids = spark.createDataFrame([(i,) for i in range(40)], "id bigint")
    ChunkTable(spark, folder, buckets=128).replace_rows(fixed_size_chunks(docs(spark, range(40))))
    table = ChunkTable(spark, folder)
    assert table.bucket_count() == 128 and table.read(ids).count() == 40
    table.replace_rows(fixed_size_chunks(docs(spark, range(40))))
    assert table.read().count() == 40
    table.merge(spark.createDataFrame([(7, "7_0", 0.5)], "source_id bigint, chunk_id string, attr_quality_score double"))
    assert [r.source_id for r in table.read().where("attr_quality_score = 0.5").collect()] == [7]
    with pytest.raises(ValueError, match="128 buckets"):
        ChunkTable(spark, folder, buckets=64)


@pytest.mark.parametrize("one, two", [(("x", None), (None, "x")), (("x", None), ("x", "y")), ((None, None), (None, ""))])
def test_updates_that_differ_in_nulls_conflict(spark, one, two):
    base = spark.createDataFrame([("c", "p", "q")], "chunk_id string, a string, b string")
    updates = spark.createDataFrame([("c", *one), ("c", *two)], base.schema)
    with pytest.raises(PySparkException, match="conflicting"):
        merge_columns(base, updates).collect()
    same = spark.createDataFrame([("c", *one), ("c", *one)], base.schema)
    assert merge_columns(base, same).collect() == [("c", *one)]


def test_narrow_taggers_do_not_shuffle_by_chunk(spark, table):
    texts_of = docs(spark, range(30), "the house and der Hund")
    table.replace_rows(fixed_size_chunks(texts_of))
    table.replace_rows(fixed_size_chunks(texts_of, producer="other"))
    requested = spark.createDataFrame([(3,), (4,)], "id bigint")
    asset = ASSETS["attr_lang"]
    expected = {r.chunk_id: (r.attr_lang_code, r.attr_lang_confidence) for r in asset.run(original_chunks(table.read())).collect()}
    run_tagger(table, "attr_lang", requested)
    tagged = {r.chunk_id: r.attr_lang_code for r in table.read().where("attr_lang_code IS NOT NULL").collect()}
    assert tagged == {"3_0": expected["3_0"][0], "4_0": expected["4_0"][0]}
    run_tagger(table, "attr_lang")
    own = table.read().where("producer_asset = 'chunks'").collect()
    assert {r.chunk_id: (r.attr_lang_code, r.attr_lang_confidence) for r in own} == expected
    assert table.read().count() == 60 and table.read().where("attr_lang_code IS NOT NULL").count() == 30
    plan = table.rewritten(asset.add, ["chunks"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "producer_asset" in plan
