"""WARC: round trips, also of payloads that hold whole records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import warc

NESTED = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a b\n/x", "p" * 100),
    (2, None, "p" * 100),
    (3, "http://c", "q" * 99),
    (4, "http://d", "q" * 99),
    (5, "http://e", NESTED),
    (6, "http://f", f"before {NESTED}{NESTED} after WARC/1.0\r\n"),
    (7, "http://g", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\nx" * 3),
    (8, None, None),
    (9, None, ""),
    (None, None, "p" * 100),
    (10, None, f"before {NESTED}{NESTED} after WARC/1.0\r\n"),
    (11, "u", "é" * 60),
    (2, None, "p" * 100),
    (12, None, "long " * 100_000 + NESTED),
    (None, "n", "alone without id " * 9),
    (None, "n", "alone without id " * 9),
]


def expected(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same, default=None)
        revisit = len(body) >= 100 and i != first and first is not None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else body))
    return sorted(out, key=str)


def read(spark, path):
    rows = warc.read_archives(spark, path, payload=True).collect()

    def number(x):
        return None if x is None else int(x)

    return sorted(
        ((number(r.id), r.payload_bytes, r.payload_digest, r.type, number(r.refers), r.payload and bytes(r.payload) if r.type == "revisit" else bytes(r.payload)) for r in rows),
        key=str,
    )


def test_round_trip(spark, folder):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    warc.write_archives(pages, folder)
    assert read(spark, folder) == expected(PAGES)
    narrow = warc.read_archives(spark, folder).select("id", "payload_digest").collect()
    assert sorted((str(r.id), r.payload_digest) for r in narrow) == sorted((str(e[0]), e[2]) for e in expected(PAGES))


@pytest.mark.parametrize("block", [700, 4096])
def test_files_read_in_many_blocks(spark, folder, block):
    """Plain archives are split at any byte; records and magics may lie across the cuts."""
    rows = PAGES[:12] * 1 + [(100 + i, None, f"{NESTED} {i}" * (i % 7)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.records_of(pages).coalesce(1).write.option("lineSep", "\n").text(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert warc.chunks(spark, folder).select("block").distinct().count() > 5
        assert read(spark, folder) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_empty_table(spark, folder):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0
