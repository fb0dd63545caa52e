"""Session helpers: SQL settings, reliable checkpoints, shared scratch space."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from chunkloom.sources import hadoop

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
# Texts vary in length, so batches for Python workers are bounded by bytes.
BATCH_DEFAULT, BATCH_BYTES = "67108864b", "8m"


def tune(spark: SparkSession) -> SparkSession:
    """Switch on the run-time re-planning the operators rely on, and keep batches
    for Python workers small unless the session says how large they may be.

    Many-to-one joins here may have a hot key; adaptive execution splits such
    partitions, also when that costs one more exchange afterwards.
    """
    for key in (
        "spark.sql.adaptive.enabled",
        "spark.sql.adaptive.skewJoin.enabled",
        "spark.sql.adaptive.forceOptimizeSkewedJoin",
    ):
        if spark.conf.get(key, "false") != "true":
            spark.conf.set(key, "true")
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local-mode session may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_open = threading.local()


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables ``materialize`` writes inside, once the block is done.

    For blocks that end in an action: a frame that still reads such a table
    must not leave the block.  Without a block the tables stay until the shared
    folder is cleared.
    """
    outer = getattr(_open, "paths", None)
    _open.paths = []
    try:
        yield
    finally:
        for path in _open.paths:
            hadoop.delete(spark, path)
        _open.paths = outer


def materialize(df: DataFrame, label: str = "step", **options: str) -> DataFrame:
    """Cut the lineage of a job by a table written to the shared folder, with ``options`` of the writer.

    Runs the plan once (a checkpoint runs its last stage twice), survives lost
    executors, and gives the steps after it columnar scans with known sizes.
    """
    spark = tune(df.sparkSession)
    path = scratch_path(spark, label)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def large_rows(group_bytes: int) -> dict[str, str]:
    """Writer options for rows of megabytes: pages of a row, groups of ``group_bytes``.

    Parquet counts a hundred rows before it first looks at their size; readers hold a whole group of nested rows.
    """
    checks = {f"parquet.page.size.row.check.{end}": "1" for end in ("min", "max")}
    return {"parquet.block.size": str(group_bytes), **checks}


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame of ``materialize`` that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path is not None:
        hadoop.delete(df.sparkSession, path)
