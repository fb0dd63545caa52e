import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chunkloom.operators.markdown import render_markdown
from chunkloom.sources import documents, files
from chunkloom.sources.chunk_table import ChunkTable  # noqa: F401


def markdown(spark, docs, **options):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "source_id bigint, doc_json string")
    return [r.markdown for r in render_markdown(df, **options).orderBy("source_id").collect()]


def test_each_kind_of_node(spark):
    nodes = [
        ({"type": "text", "text": "a"}, "a\n"),
        ({"type": "section_header", "title": "T"}, "## T\n"),
        ({"type": "table", "data": {"rows": [["h", "i"], ["1", "2"]]}}, "| h | i |\n|---||---|\n| 1 | 2 |\n"),
        ({"type": "table", "data": {"rows": [["h"]]}}, "| h |\n|---|\n"),
        ({"type": "table"}, "\n"),
        ({"type": "image", "id": "p"}, "[Image: p]\n"),
        ({"type": "image"}, "[Image: img]\n"),
        ({"type": "code", "text": "x", "language": "py"}, "```py\nx\n```\n"),
        ({"type": "code", "text": "x"}, "```\nx\n```\n"),
        ({"type": "list", "items": [{"text": "a"}, "b", {"x": 1}, {"text": "c"}]}, "- a\n- c\n"),
        ({"type": "other", "text": "hidden"}, "\n"),
        ({"text": "no type"}, "\n"),
    ]
    assert markdown(spark, [{"children": [n]} for n, _ in nodes]) == [text for _, text in nodes]


def test_order_title_and_errors(spark):
    deep = {"type": "section_header", "title": "1"}
    top = deep
    for i in range(2, 9):
        deep["children"] = [{"type": "section_header", "title": str(i)}]
        deep = deep["children"][0]
    page = lambda t: {"children": [{"type": "text", "text": t}]}
    doc = {"name": "N", "pages": {"2": page("two"), "10": page("ten"), "1": page("one")}, "children": [top, {"type": "text", "text": "end"}]}
    headings = "\n\n".join(f"{'#' * min(6, i + 1)} {i}" for i in range(1, 9))
    assert markdown(spark, [doc, "nope", {}, {"name": "x"}]) == [f"# N\n\n{headings}\n\nend\ntwo\nten\none\n", None, "\n", "# x\n"]
    assert markdown(spark, [doc, {"name": "x"}], title=False) == [f"{headings}\n\nend\ntwo\nten\none\n", "\n"]


def test_wide_and_uneven_trees_keep_document_order(spark):
    rng = random.Random(4)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(0, 4))] if depth else []
        return {"type": "text", "text": f"t{rng.randrange(10**6)}", "children": kids}

    def order(node):
        return [node["text"]] + [t for c in node["children"] for t in order(c)]

    docs = [{"children": [tree(5) for _ in range(15)]} for _ in range(3)]
    want = ["\n".join(t for c in d["children"] for t in order(c)) + "\n" for d in docs]
    assert markdown(spark, docs) == want


def test_escaped_keys_are_opened_like_others(spark):
    inner = '{"type": "x", "\\u0063hildren": [{"type": "x", "\\u0063hildren": [{"type": "text", "text": "deep"}]}]}'
    assert markdown(spark, ['{"\\u0063hildren": [' + inner + "]}"]) == ["deep\n"]


def test_null_cells_keep_their_place(spark):
    table = '{"children": [{"type": "table", "data": {"rows": [["a", "c"], ["b", null], [null, "d"]]}}]}'
    assert markdown(spark, [table]) == ["| a | c |\n|---||---|\n| b |  |\n|  | d |\n"]


def test_page_counts(spark):
    pdfs = [b"%PDF /Count 12 /Count 3", b"garbage", b"", b"\xff\xfe/Count\n 7", b"/Count 99999999999999"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(pdfs)], "i int, content binary")
    got = df.select("i", files.page_count(F.col("content")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [12, 0, 0, 7, 0]


def test_placeholder_document(spark):
    row = spark.range(1).select(files.placeholder_document(F.lit(5), F.lit(2)).alias("a"), files.placeholder_document(F.lit(6), F.lit(0)).alias("b")).first()
    size = {"width": 612.0, "height": 792.0}
    assert json.loads(row.a) == {"name": "source_5", "pages": {"1": {"page_no": 1, "size": size}, "2": {"page_no": 2, "size": size}}}
    assert json.loads(row.b) == {"name": "source_6", "pages": {}}


def test_ingest_takes_pdfs_only(spark, folder):
    os.makedirs(f"{folder}/sub")
    for name, data in {"b.pdf": b"%PDF b", "sub/a.PDF": b"%PDF a", "c.txt": b"no"}.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    rows = files.source_rows(files.scan_pdfs(spark, folder), first_id=41).orderBy("id").collect()
    assert [(r.id, r.original_name, r.size, r.partition_key) for r in rows] == [(41, "b.pdf", 6, "src_41"), (42, "a.PDF", 6, "src_42")]
    assert rows[0].mime_type == "application/pdf" and rows[0].storage_uri == "s3://sources/41/original.pdf"
    import hashlib

    assert rows[1].sha256 == hashlib.sha256(b"%PDF a").hexdigest()


def test_bodies_by_convention(spark, folder):
    for source, body in {1: '{"name": "x"}', 2: "{broken"}.items():
        os.makedirs(f"{folder}/{source}/extract_mineru")
        with open(f"{folder}/{source}/extract_mineru/doc.docling.json", "w") as f:
            f.write(body)
    bodies = documents.read_bodies(spark, folder)
    assert sorted((r.source_id, r.extractor_name, r.error) for r in bodies.collect()) == [(1, "mineru", None), (2, "mineru", "unparsable body")]
    asked = spark.createDataFrame([(1,), (2,), (3,)], "source_id bigint")
    got = documents.require_bodies(asked, bodies).orderBy("source_id").collect()
    assert [r.error for r in got] == [None, "unparsable body", "missing body"]


def test_document_sink_commits_last_and_cleans_up(spark, folder):
    rows = spark.createDataFrame([(1, "sources/1/original.pdf", "ab", '{"name": "x"}')], "source_id bigint, source_key string, sha256 string, doc_json string")
    documents.write_documents(rows, folder, "r1")
    manifest = json.loads(spark.read.parquet(f"{folder}/manifests/run=r1").first().manifest)
    assert manifest["source_refs"] == [{"bucket": "sources", "key": "sources/1/original.pdf", "sha256": "ab"}]
    assert manifest["schema_version"] == 1 and manifest["images"] == [] and manifest["dagster_run_id"] == "r1"
    pictures = spark.createDataFrame([(1, "b.png", bytearray(b"b")), (1, "a.png", bytearray(b"a")), (2, "c.png", bytearray(b"c"))], "source_id bigint, filename string, data binary")
    documents.write_documents(rows, folder, "r3", pictures)
    assert json.loads(spark.read.parquet(f"{folder}/manifests/run=r3").first().manifest)["images"] == ["a.png", "b.png"]
    bad = rows.withColumn("doc_json", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(PySparkException, match="disk full"):
        documents.write_documents(bad, folder, "r2")
    assert documents.complete_runs(spark, folder, ["r1", "r2"]) == ["r1"]
    assert not os.path.exists(f"{folder}/bodies/run=r2")
