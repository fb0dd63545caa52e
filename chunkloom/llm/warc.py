"""WARC archives: writing with revisits, reading by boundary-chain verification.

Writing: one record per page; of records with equal payloads of at least
``MIN_SHARED`` bytes the one with the smallest page_id is the response and the rest are
revisits that name it and carry no payload.  Spark's text writer makes the
archives.

Reading: Spark's text reader splits the archives at the record magic, also
inside payloads, and tasks emit for each candidate where it begins and where its
successor must begin by its own Content-Length.  Pointer jumping from the start of each file
(reach doubles in each round) keeps only candidates on the chain; any other
magic is payload.  Payloads cut by a magic are put together again from their
pieces.

A null or empty html is an empty payload.  Rows that repeat the smallest page_id
of a payload are all responses.  A null page_id is larger than any other; a
payload without ids has only responses.  Control characters and blanks in a URL
are written as %20; a null URL is left out.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.session import discard, materialize

# The format's version line and line ends.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"

MIN_SHARED = 100
DATE = "2024-01-01T00:00:00Z"


def _field(name: str, value: Column) -> Column:
    """A header line, empty for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records_of(pages: DataFrame, id_column="page_id", url_column="url", payload_column="html") -> DataFrame:
    """Pages -> one column ``value``, each row a whole record but for its last line feed."""
    payload = F.coalesce(payload_column, F.lit(""))
    rows = pages.select(
        F.col(id_column).alias("page_id"),
        F.regexp_replace(F.col(url_column), r"[\x00-\x20\x7f]", "%20").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("bytes"),
        F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"),
    )
    shared = rows.where(F.col("bytes") >= MIN_SHARED).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    # A table on its own: adaptive execution can then split a payload that most pages share.
    shared = materialize(shared.where("n > 1").drop("n"), "shared")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("string")
    joined = rows.join(shared, "digest", "left").withColumn("refers", refers)
    is_revisit = F.col("refers").isNotNull()
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))

    def name(number: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))

    head = F.concat(
        F.lit(MAGIC),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n")),
        _field("WARC-Record-ID", name(F.col("page_id"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Refers-To", F.when(is_revisit, name(F.col("refers")))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Payload-Length", F.col("bytes").cast("string")),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.octet_length(body).cast("string")),
    )
    return joined.select(F.concat(head, F.lit("\r\n"), body, F.lit(END[:-1])).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Write one archive for each task into ``path``."""
    records_of(pages, **columns).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _scan(keep: bool):
    """Chunks between magics -> candidates; with ``keep`` only their place and bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        split, seq, at = None, 0, 0
        for batch in batches:
            files, blocks, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
            rows = []
            for file, block, value in zip(files, blocks, values):
                if (file, block) != split:
                    split, seq, at = (file, block), 0, 0
                row = {"file": file, "block": block, "seq": seq}
                rows.append(row | ({"value": value} if keep else {"at": at, "n": len(value)} | candidate(value)))
                seq, at = seq + 1, at + len(MAGIC) + len(value)
            kind = KEPT if keep else NARROW
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kind))

    return run


def _arrow_schemas():
    import pyarrow as pa

    place = [("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64())]
    facts = [("at", pa.int64()), ("n", pa.int64()), ("head", pa.int64()), ("length", pa.int64())]
    texts = [(c, pa.string()) for c in ("id", "type", "refers", "uri", "digest")]
    return [*place, ("value", pa.binary())], [*place, *facts, *texts, ("payload_length", pa.int64()), ("found", pa.string())]


KEPT, NARROW = _arrow_schemas()
KEPT_DDL = "file string, block long, seq long, value binary"
NARROW_DDL = (
    "file string, block long, seq long, at long, n long, head long, length long, id string, type string,"
    " refers string, uri string, digest string, payload_length long, found string"
)


def candidate(chunk: bytes) -> dict:
    """What the bytes after a magic say if they are a record: its header's size, content
    length and fields, and the payload's digest if all of it is there."""
    head, found, rest = chunk.partition(END.encode())
    fields = dict(re.findall(rb"(?m)^([A-Za-z-]+): ([^\r\n]*)\r?$", head)) if found else {}
    length = fields.get(b"Content-Length", b"")
    if not re.fullmatch(rb"[0-9]{1,18}", length):
        return {}

    def text(name: bytes) -> str | None:
        return fields[name].decode("utf-8", "replace") if name in fields else None

    def number(name: bytes) -> str | None:
        return (text(name) or "").removeprefix("<urn:page:").removesuffix(">") or None

    size = int(length)
    said = text(b"WARC-Payload-Length")
    return {
        "head": len(head) + len(END),
        "length": size,
        "id": number(b"WARC-Record-ID"),
        "type": text(b"WARC-Type"),
        "refers": number(b"WARC-Refers-To"),
        "uri": text(b"WARC-Target-URI"),
        "digest": (text(b"WARC-Payload-Digest") or "").removeprefix("sha256:") or None,
        "payload_length": int(said) if said and re.fullmatch("[0-9]{1,18}", said) else None,
        "found": hashlib.sha256(rest[:size]).hexdigest() if len(rest) >= size + len(END) else None,
    }


def chunks(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """The archives' bytes between magics, by file, block and place in the block."""
    rows = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )
    return rows.mapInArrow(_scan(keep), KEPT_DDL if keep else NARROW_DDL)


def located(narrow: DataFrame) -> DataFrame:
    """Adds ``pos``, where each chunk's magic stands in its file, and ``file_end``.

    Only one number for each block is carried from block to block.
    """
    step = len(MAGIC)
    sizes = narrow.groupBy("file", "block").agg(F.sum(F.col("n") + step).alias("size"))
    by_file = Window.partitionBy("file").orderBy("block")
    bases = sizes.withColumn("base", F.sum("size").over(by_file) - F.col("size")).withColumn(
        "file_end", F.sum("size").over(Window.partitionBy("file")) - step
    )
    return narrow.join(bases.drop("size"), ["file", "block"]).withColumn("pos", F.col("base") + F.col("at") - step).drop("base", "at")


def reachable(links: DataFrame) -> DataFrame:
    """Candidates ``(file, pos, next)`` -> (file, pos) of those on the chain from 0.

    Each round sends every pointer twice as far and marks what the marked ones
    point to, so a chain of n records takes log2(n) rounds.
    """
    state = materialize(links.withColumn("reached", F.col("pos") == 0), "chain")
    marked = state.where("reached").count()
    while True:
        targets = state.select("file", F.col("pos").alias("next"), F.col("next").alias("after"))
        jumped = state.join(targets, ["file", "next"], "left").select("file", "pos", F.col("after").alias("next"), "reached", F.lit(True).alias("own"))
        hits = state.where("reached AND next IS NOT NULL").select(
            "file", F.col("next").alias("pos"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("reached"), F.lit(False).alias("own")
        )
        before, state = state, materialize(
            jumped.union(hits)
            .groupBy("file", "pos")
            .agg(F.max("next").alias("next"), F.max("reached").alias("reached"), F.max("own").alias("own"))
            .where("own")
            .drop("own"),
            "chain",
        )
        discard(before)
        now = state.where("reached").count()
        if now == marked:
            return state.where("reached").select("file", "pos")
        marked = now


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per verified record: id, type, refers, uri, payload_bytes, payload_digest and,
    with ``payload``, the bytes (null for revisits)."""
    narrow = materialize(located(chunks(spark, path)), "chunks")
    follows = F.col("pos") + len(MAGIC) + F.col("head") + F.col("length") + len(END)
    links = narrow.where("pos >= 0 AND length IS NOT NULL").where(follows <= F.col("file_end"))
    on_chain = reachable(links.select("file", "pos", follows.alias("next"))).withColumn("on_chain", F.lit(True))
    marked = materialize(narrow.join(on_chain, ["file", "pos"], "left"), "marked")
    records = marked.where("on_chain")

    # Whose bytes a chunk holds: the last record before it in its block, or else in earlier blocks.
    record_pos = F.when(F.col("on_chain"), F.col("pos"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("file", "block").agg(F.max(record_pos).alias("top")).withColumn("carried", F.max("top").over(earlier)).drop("top")
    inside = Window.partitionBy("file", "block").orderBy("seq")
    owned = (
        marked.withColumn("owner", F.last(record_pos, ignorenulls=True).over(inside))
        .join(carried, ["file", "block"])
        .select("file", "block", "seq", "pos", F.coalesce("owner", "carried").alias("owner"))
    )
    whole = F.col("found").isNotNull()
    cut = records.where(F.lit(payload) | ~whole).select("file", F.col("pos").alias("owner"), "head", "length")
    wanted = materialize(owned.join(cut, ["file", "owner"]), "pieces")
    joined = F.aggregate(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]),
        F.struct(F.lit(None).cast("binary").alias("bytes")),
        lambda a, v: F.struct(F.coalesce(F.concat(a["bytes"], F.encode(F.lit(MAGIC), "UTF-8"), v), v).alias("bytes")),
        lambda a: a["bytes"],
    )
    bodies = (
        chunks(spark, path, keep=True)
        .join(wanted, ["file", "block", "seq"])
        .groupBy("file", F.col("owner").alias("pos"))
        .agg(joined.alias("bytes"))
    )
    body = F.substring("bytes", F.col("head").cast("int") + 1, F.col("length").cast("int"))
    revisit = F.col("type") == "revisit"
    return records.join(bodies, ["file", "pos"], "left").select(
        "id",
        "type",
        "refers",
        "uri",
        F.when(revisit, F.col("payload_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.coalesce("found", F.sha2(body, 256))).alias("payload_digest"),
        *([F.when(~revisit, body).alias("payload")] if payload else []),
    )
