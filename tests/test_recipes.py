import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chunkloom.functions.templates import TemplateError
from chunkloom.operators import synthesis
from chunkloom.operators.models import Completion
from chunkloom.plans import recipes
from chunkloom.plans.filters import QueryError
from chunkloom.schema import conform
from chunkloom.sources.dataset_sink import dataset_infos, read_splits


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"1_{i}", 1, f"text {i}" + "x" * 300, i) for i in range(12)]
    return conform(spark.createDataFrame(rows, "chunk_id string, source_id bigint, text string, token_count int"))


class Answers:
    def __init__(self, content="{}", error=None):
        self.content, self.error = content, error

    def complete(self, prompts, max_tokens):
        return [Completion(None if self.error else self.content.replace("PROMPT", json.dumps(p)), "m", error=self.error) for p in prompts]


def good():
    return Answers('{"instruction": PROMPT, "output": "o"}')


def prose():
    return Answers("prose")


def recipe(where=None, **config):
    return {"filter": {"where": where}, "schema": {"template": "sft_synthesis_qa", "config": config}}


def test_default_prompt_and_rows(chunks):
    rows = recipes.dataset_rows(chunks, recipe("token_count < 3"), good).orderBy("chunk_id").collect()
    text = chunks.where("chunk_id = '1_0'").first().text
    assert rows[0].instruction == f'Generate a question and answer for the following text:\n\n{text}\n\nRespond with JSON: {{"instruction": "...", "output": "..."}}'
    assert [r.chunk_id for r in rows] == ["1_0", "1_1", "1_2"] and rows[0].output == "o"


def test_failures_skip_or_raise(chunks):
    assert recipes.dataset_rows(chunks, recipe()).count() == 0  # the mock answers no JSON object
    assert recipes.dataset_rows(chunks, recipe(), lambda: Answers(error="down")).count() == 0
    with pytest.raises(PySparkException, match="no instruction and output for chunk"):
        recipes.dataset_rows(chunks, recipe(fallback_on_failure=False), prose).collect()
    with pytest.raises(TemplateError):
        recipes.dataset_rows(chunks, recipe(prompt_template="{nope}"))


def test_preview(chunks):
    assert recipes.preview(chunks, recipe(prompt_template="{chunk_id}:{token_count}"), 3, good).orderBy("chunk_id").first().instruction == "1_0:0"
    rows = recipes.preview(chunks, recipe(fallback_on_failure=True), 4, prose).collect()
    assert len(rows) == 4 and all(r.output == "prose" and len(r.instruction) == 200 for r in rows)
    with pytest.raises(PySparkException):
        recipes.preview(chunks, recipe(), 3, prose).collect()
    with pytest.raises(recipes.RecipeError):
        recipes.preview(chunks, recipe("token_count > 99"), 3, good)
    with pytest.raises(recipes.RecipeError):
        recipes.preview(chunks, {"schema": {"template": "other"}}, 3, good)
    for n in (2, 6):
        with pytest.raises(QueryError):
            recipes.preview(chunks, recipe(), n, good)


def test_published_data_set(spark, chunks, folder):
    definition = {**recipe(prompt_template="{chunk_text}"), "output": {"splits": {"validation": 0.5}}}
    done = recipes.materialize_dataset(chunks, definition, folder, 9, "v2", good)
    assert done["path"].endswith("/9_v2") and done["sample_count"] == 12
    files = sorted(os.listdir(f"{done['path']}/data"))
    assert [f for f in files if f.endswith(".parquet")] == ["train-00000.parquet", "validation-00000.parquet"]
    assert pq.read_schema(f"{done['path']}/data/train-00000.parquet").names == ["instruction", "output", "chunk_id"]
    rows = {r.chunk_id: r.split for r in read_splits(spark, done["path"]).collect()}
    want = {r.chunk_id: r.s for r in chunks.select("chunk_id", synthesis.split_of(F.col("chunk_id"), 0.5).alias("s")).collect()}
    assert rows == want and set(rows.values()) == {"train", "validation"}
    with open(f"{done['path']}/recipe.json") as f:
        assert json.load(f) == definition
    with open(f"{done['path']}/README.md") as f:
        assert f.read() == "# Dataset 9_v2\n\nGenerated by sft_synthesis_qa.\n"
    with open(f"{done['path']}/dataset_infos.json") as f:
        info = json.load(f)["default"]
    assert info["splits"]["train"]["num_examples"] + info["splits"]["validation"]["num_examples"] == 12
    assert info["dataset_size"] == done["size_bytes"] == sum(os.path.getsize(f"{done['path']}/data/{n}") for n in files if n.endswith(".parquet"))


def test_empty_data_set_is_valid(spark, chunks, folder):
    done = recipes.materialize_dataset(chunks, recipe("token_count > 99"), folder, 1, "v1", good, card="# Card")
    assert done["sample_count"] == 0 and read_splits(spark, done["path"]).count() == 0
    assert pq.read_table(f"{done['path']}/data/validation-00000.parquet").num_rows == 0
    with open(f"{done['path']}/README.md") as f:
        assert f.read() == "# Card"


def test_infos_shape():
    info = dataset_infos({"train": (10, 2), "validation": (5, 1)})["default"]
    assert info["download_size"] == 15 and info["splits"]["validation"] == {"name": "validation", "num_bytes": 5, "num_examples": 1, "dataset_name": "default"}
    assert info["features"]["output"] == {"dtype": "string", "_type": "Value"}


def test_keys(spark):
    assert recipes.parse_dataset_key("ds_5_v2") == (5, "v2")
    for bad in ("ds_5_2", "ds_x_v1", "src_1", "ds_5_v", ""):
        with pytest.raises(recipes.RecipeError):
            recipes.parse_dataset_key(bad)
    df = spark.createDataFrame([("src_12",), ("12",), ("src_x",), ("src_",), (None,)], "k string")
    assert [r[0] for r in df.select(recipes.source_key_column(F.col("k"))).collect()] == [12, 12, None, None, None]
