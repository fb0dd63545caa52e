"""Ingesting PDF files as sources, and the placeholder document of a PDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.hashing import sha256_hex
from chunkloom.plans.ranking import rank_in_group

# Accepted type, key formats, page size of the placeholder.
PDF_MIME = "application/pdf"
PAGE_WIDTH = 612.0
PAGE_HEIGHT = 792.0
# A file that says it has more pages is not believed: its placeholder would be one row's array of that size.
MAX_PAGES = 100_000


def scan_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the PDF files below a folder; others are not listed."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "content")
    )


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, original_name, sha256, size) of ``files(path, content)``; narrow,
    and the last step that holds contents."""
    name = F.nullif(F.element_at(F.split("path", "/"), -1), F.lit(""))
    return files.select(
        "path",
        F.coalesce(name, F.lit("upload.pdf")).alias("original_name"),
        sha256_hex(F.col("content")).alias("sha256"),
        F.length("content").cast("bigint").alias("size"),
    )


def source_rows(files: DataFrame, first_id: int = 1, store: str = "s3://sources") -> DataFrame:
    """New sources from ``files(path, content)``, numbered by path from
    ``first_id`` on; ``store`` is where their contents are kept."""
    numbered = rank_in_group(
        fingerprints(files).withColumn("_all", F.lit(0)), ["_all"], ["path"], "_rank"
    )
    sid = (F.col("_rank") + first_id).alias("id")
    text_id = (F.col("_rank") + first_id).cast("string")
    return numbered.select(
        sid,
        F.lit("file").alias("kind"),
        "original_name",
        "sha256",
        "size",
        F.lit(PDF_MIME).alias("mime_type"),
        F.concat(F.lit(f"{store}/"), text_id, F.lit("/original.pdf")).alias("storage_uri"),
        F.concat(F.lit("src_"), text_id).alias("partition_key"),
    )


def _claimed_pages(content: Column) -> Column:
    return F.regexp_extract(F.decode(content, "ISO-8859-1"), r"/Count\s+(\d+)", 1)


def page_count(content: Column) -> Column:
    """First ``/Count n`` in the bytes, else 0; also 0 where ``page_error`` says that n is not believed."""
    found = _claimed_pages(content).try_cast("int")
    return F.when(found <= MAX_PAGES, found).otherwise(F.lit(0))


def page_error(content: Column) -> Column:
    """What is wrong with the page count, or NULL."""
    digits = F.regexp_replace(_claimed_pages(content), "^0+", "")
    too_many = (F.length(digits) > 9) | (digits.try_cast("int") > MAX_PAGES)
    return F.when(too_many, F.concat(F.lit(f"more than {MAX_PAGES} pages: "), F.substring(digits, 1, 20)))


def placeholder_document(source_id: Column, pages: Column) -> Column:
    """JSON of a document with n empty pages and no text."""
    page = lambda n: F.struct(
        n.cast("string").alias("key"),
        F.struct(
            n.cast("int").alias("page_no"),
            F.struct(F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height")).alias("size"),
        ).alias("value"),
    )
    numbers = F.when(pages > 0, F.sequence(F.lit(1), pages)).otherwise(
        F.array().cast("array<int>")
    )
    return F.to_json(
        F.struct(
            F.concat(F.lit("source_"), source_id.cast("string")).alias("name"),
            F.map_from_entries(F.transform(numbers, page)).alias("pages"),
        )
    )
