"""PDF scans, page counts and their limit."""

from pyspark.sql import functions as F

from chunkloom.sources import files


def test_page_counts_and_errors(spark):
    said = {"/Count 7 /Count 9": 7, "/Count\n12": 12, "none": 0, "/Count x": 0, "/Count 100000": 100000, "/Count 100001": 0, "/Count 99999999999": 0, "/Count 0000000000012": 12}
    rows = spark.createDataFrame([(k, bytearray(k.encode())) for k in said], "k string, content binary")
    got = {r.k: r for r in rows.select("k", files.page_count(F.col("content")).alias("n"), files.page_error(F.col("content")).alias("e")).collect()}
    assert {k: r.n for k, r in got.items()} == said
    assert {k for k, r in got.items() if r.e} == {"/Count 100001", "/Count 99999999999"}
    assert "99999999999" in got["/Count 99999999999"].e


def test_scan_lists_pdf_files_only(spark, folder):
    from chunkloom.sources import hadoop

    for name, text in (("a.pdf", "%PDF /Count 3"), ("deep/b.PDF", "%PDF"), ("c.txt", "no")):
        hadoop.write_text(spark, f"{folder}/{name}", text)
    found = files.source_rows(files.scan_pdfs(spark, folder), 5).orderBy("id").collect()
    assert [(r.id, r.original_name, r.size, r.partition_key) for r in found] == [(5, "a.pdf", 13, "src_5"), (6, "b.PDF", 4, "src_6")]
