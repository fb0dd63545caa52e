"""Small file operations through the session's own file system client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def has_data(spark: SparkSession, path: str) -> bool:
    """True when the folder exists and lists anything but hidden files."""
    fs, p = _path(spark, path)
    return fs.exists(p) and any(
        not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p)
    )


def listing(spark: SparkSession, folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the folder's files with that suffix, by name."""
    fs, p = _path(spark, folder)
    if not fs.exists(p):
        return []
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p)]
    return sorted(f for f in found if f[0].endswith(suffix))


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, p = _path(spark, src)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dst)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"could not rename {src} to {dst}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text; Spark's readers skip names that start with ``_``."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
