"""The chunk table: Parquet in ``producer_asset`` and source-bucket folders.

A folder per source would be ruinous with many sources, so sources are hashed
into a fixed number of buckets; a write touches only the buckets of its
sources and replaces them by dynamic partition overwrite.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.schema import CHUNK_SCHEMA, conform
from chunkloom.session import materialize, scratch_tables, tune
from chunkloom.sources import hadoop

LAYOUT = ["producer_asset", "source_bucket"]
DEFAULT_BUCKETS = 64
# Source ids that are broadcast at once.
IDS_AT_ONCE = 500_000


def merge_columns(table: DataFrame, updates: DataFrame) -> DataFrame:
    """Column mode: overwrite only the incoming columns of matching rows.

    An incoming NULL overwrites; rows without a chunk id and rows that match
    nothing are ignored; a column new to the table is added.  Two different
    incoming rows for one chunk are an error, raised when the result is
    computed.
    """
    names = [c for c in updates.columns if c != "chunk_id"]
    row = F.struct(*[F.col(n) for n in names])
    # The hash passes over NULLs, so each value goes in with a flag.
    tagged = [c for n in names for c in (F.col(n).isNull(), F.col(n))]
    new = updates.where("chunk_id IS NOT NULL").select(
        "chunk_id", row.alias("_row"), F.xxhash64(*tagged).alias("_print")
    )
    one = new.groupBy("chunk_id").agg(
        F.first("_row").alias("_row"), F.min("_print").alias("_p"), F.max("_print").alias("_q")
    ).select(
        "chunk_id",
        F.when(F.col("_p") == F.col("_q"), F.col("_row"))
        .otherwise(F.raise_error(F.concat(F.lit("conflicting updates for "), "chunk_id")))
        .alias("_new"),
        F.lit(True).alias("_hit"),
    )
    joined = table.join(one, "chunk_id", "left")
    types = {f.name: f.dataType for f in table.schema.fields}

    def pick(name: str) -> Column:
        if name not in names:
            return F.col(name)
        new = F.col(f"_new.`{name}`")
        if name not in types:
            return new.alias(name)
        return F.when(F.col("_hit"), new.cast(types[name])).otherwise(F.col(name)).alias(name)

    added = [n for n in names if n not in types]
    return joined.select(*[pick(c) for c in table.columns + added])


@dataclass(frozen=True)
class ChunkTable:
    """The table at ``path``.

    The number of buckets is settled by the first write and kept beside the data;
    ``buckets`` is for a table that does not exist yet, and must agree with one that does.
    """

    spark: SparkSession
    path: str
    buckets: int | None = None

    def __post_init__(self) -> None:
        tune(self.spark)
        stored = self._layout().get("buckets")
        if stored is not None and self.buckets not in (None, stored):
            raise ValueError(f"the table has {stored} buckets, not {self.buckets}")

    def _layout(self) -> dict:
        """Bucket count and schema as noted by writers, empty before the first write.

        Kept in a small file beside the data: asking every Parquet footer
        would grow with the table.
        """
        noted = f"{self.path}/_chunk_layout.json"
        return json.loads(hadoop.read_text(self.spark, noted)) if hadoop.exists(self.spark, noted) else {}

    def bucket_count(self) -> int:
        return self._layout().get("buckets") or self.buckets or DEFAULT_BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("source_id"), F.lit(self.bucket_count())).cast("int")

    def read(self, requested: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the sources ``requested(id)``, whose buckets
        alone are scanned.  An absent table reads as empty."""
        stored = self._stored()
        if requested is not None:
            wanted = requested.select(F.col("id").alias("source_id"))
            stored = stored.where(self._bucket_in(wanted)).join(wanted, "source_id", "left_semi")
            stored = stored.select(*self._schema().fieldNames())
        return stored.drop("source_bucket")

    def _bucket_in(self, rows: DataFrame) -> Column:
        """Predicate on the bucket folders of ``rows(source_id)``.  The list has
        at most ``buckets`` numbers; as literals they prune the scan for sure."""
        found = rows.select(self._bucket().alias("b")).distinct().collect()
        return F.col("source_bucket").isin([r.b for r in found])

    def _schema(self) -> T.StructType:
        """Base schema, layout and the columns added since."""
        noted = self._layout().get("schema")
        if noted is not None:
            return T.StructType.fromJson(noted)
        return T.StructType([*CHUNK_SCHEMA.fields, T.StructField("source_bucket", T.IntegerType())])

    def _stored(self) -> DataFrame:
        schema = self._schema()
        if not hadoop.has_data(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).select(*schema.fieldNames())

    def _overwrite(self, rows: DataFrame, *, laid_out: bool = False) -> None:
        known = self._schema()
        added = [f for f in rows.schema.fields if f.name not in known.fieldNames()]
        if added or not self._layout():
            wider = T.StructType([*known.fields, *added])
            layout = {"buckets": self.bucket_count(), "schema": wider.jsonValue()}
            hadoop.write_text(self.spark, f"{self.path}/_chunk_layout.json", json.dumps(layout))
        # The rebalance hint sizes the files of each folder and lets adaptive
        # execution split the folder of a hot source over several tasks.
        (
            (rows if laid_out else rows.hint("rebalance", *LAYOUT))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*LAYOUT)
            .parquet(self.path)
        )

    def _touched(self, keys: DataFrame) -> tuple[set[tuple], DataFrame]:
        """Folders of ``keys`` (at most ``buckets`` per producer) and the rows
        stored in them; the folder names are literals, so they prune the scan."""
        folders = {tuple(r) for r in keys.select(*LAYOUT).distinct().collect()}
        inside = F.lit(False)
        for producer in sorted({p for p, _ in folders}):
            buckets = [b for p, b in folders if p == producer]
            inside = inside | (
                (F.col("producer_asset") == producer) & F.col("source_bucket").isin(buckets)
            )
        return folders, self._stored().where(inside)

    def replace_rows(self, rows: DataFrame, *, replace_empty: DataFrame | None = None, derived: bool = False) -> None:
        """Row mode: new rows of a (source, producer) replace its old rows.

        A source without new rows keeps its old ones, unless it is listed in
        ``replace_empty(source_id, producer_asset)``.  ``derived`` says that ``rows`` come from scans of this table
        without an exchange and that ``replace_empty`` lists all their sources: a task's rows then lie in the folders of
        its scan, so they are written as they are made, with no copy and no exchange.
        """
        if derived and replace_empty is None:
            raise ValueError("derived rows need the list of their sources")
        with scratch_tables(self.spark):
            self._replace(rows, replace_empty, derived)

    def _replace(self, rows: DataFrame, replace_empty: DataFrame | None, derived: bool) -> None:
        new = conform(rows).withColumn("source_bucket", self._bucket())
        if not hadoop.has_data(self.spark, self.path):
            self._overwrite(new)
            return
        layout = ["source_id", *LAYOUT]
        if replace_empty is not None:
            cleared = replace_empty.select("source_id", "producer_asset").withColumn("source_bucket", self._bucket())
            keys = cleared.select(*layout)
        if not derived:
            new = materialize(new, "rows")
            keys = new.select(*layout) if replace_empty is None else new.select(*layout).unionByName(keys)
        keys = materialize(keys.distinct(), "keys")
        folders, stored = self._touched(keys)
        # Folders that lose all their rows are not read, found by a scan without texts.
        old = stored.select(*layout).distinct().join(keys, layout, "left_anti")
        partly, stored = self._touched(old)
        kept = stored.join(keys.drop("source_bucket"), ["source_id", "producer_asset"], "left_anti")
        result = new.unionByName(kept, allowMissingColumns=True) if partly else new
        before = {f: hadoop.listing(self.spark, self._folder(*f), "") for f in folders} if replace_empty is not None else {}
        # Old rows that stay come out of an exchange in part: those are laid out.
        self._overwrite(result, laid_out=derived and not partly)
        for folder, files in before.items():
            # A folder without rows is not part of the write, so its files are still the old ones: remove it.
            if files and hadoop.listing(self.spark, self._folder(*folder), "") == files:
                hadoop.delete(self.spark, self._folder(*folder))

    def _folder(self, producer: str, bucket: int) -> str:
        return f"{self.path}/producer_asset={producer}/source_bucket={bucket}"

    def rewritten(
        self, add: Callable[[DataFrame], DataFrame], producers: list[str], requested: DataFrame | None = None
    ) -> DataFrame:
        """Stored rows of the producers with the columns that ``add`` gives each row by itself;
        of ``requested(id)`` sources if given.  Whole tables are not shuffled by any key."""
        stored = self._stored().where(F.col("producer_asset").isin(producers))
        if requested is None:
            return self._typed(add(stored))
        wanted = requested.select(F.col("id").alias("source_id"))
        stored = stored.where(self._bucket_in(wanted))
        rest = stored.join(wanted, "source_id", "left_anti")
        added = self._typed(add(stored.join(wanted, "source_id", "left_semi")))
        return added.unionByName(rest, allowMissingColumns=True)

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Columns in the stored order and types, new ones behind."""
        known = self._schema()
        return rows.select(
            *[F.col(f.name).cast(f.dataType) for f in known.fields],
            *[c for c in rows.columns if c not in known.fieldNames()],
        )

    def rewrite(
        self, add: Callable[[DataFrame], DataFrame], producers: list[str], requested: DataFrame | None = None
    ) -> None:
        """Write what ``rewritten`` gives; its only exchange lays rows out by folder."""
        if hadoop.has_data(self.spark, self.path):
            self._overwrite(self.rewritten(add, producers, requested))

    def with_columns(self, columns: dict[str, Column], producers: list[str], requested: DataFrame) -> DataFrame | None:
        """Stored rows in the buckets of the ``requested(id)`` sources; ``columns`` are set in rows of these sources.

        No row leaves the task that scans it: the ids are broadcast, those of some buckets to the scan of
        these buckets, at most ``IDS_AT_ONCE`` at a time.
        """
        types = {f.name: f.dataType for f in self._schema().fields}
        wanted = requested.select(F.col("id").alias("source_id")).where("source_id IS NOT NULL").distinct()
        parts: list[tuple[list[int], int]] = []
        for bucket, n in sorted(wanted.groupBy(self._bucket().alias("bucket")).count().collect()):
            if parts and parts[-1][1] + n <= IDS_AT_ONCE:
                parts[-1] = (parts[-1][0] + [bucket], parts[-1][1] + n)
            else:
                parts.append(([bucket], n))
        stored = self._stored().where(F.col("producer_asset").isin(producers))
        done = []
        for buckets, n in parts:
            rows = stored.where(F.col("source_bucket").isin(buckets))
            ids, blocks = wanted.where(self._bucket().isin(buckets)), -(-n // IDS_AT_ONCE)
            flags = [f"_wanted{i}" for i in range(blocks)]
            for i, flag in enumerate(flags):
                block = ids.where(F.pmod(F.hash("source_id"), F.lit(blocks)) == i)
                rows = rows.join(F.broadcast(block.withColumn(flag, F.lit(True))), "source_id", "left")
            mine = F.coalesce(*flags, F.lit(False)) & F.col("chunk_id").isNotNull()
            new = {c: F.when(mine, made.cast(types[c]) if c in types else made) for c, made in columns.items()}
            new = {c: made.otherwise(F.col(c)) if c in types else made for c, made in new.items()}
            done.append(rows.select(*[new.pop(c, F.col(c)).alias(c) for c in stored.columns], *[made.alias(c) for c, made in new.items()]))
        return reduce(DataFrame.union, done) if done else None

    def set_columns(self, columns: dict[str, Column], producers: list[str], requested: DataFrame) -> None:
        """Write what ``with_columns`` gives, with no exchange."""
        if hadoop.has_data(self.spark, self.path):
            rows = self.with_columns(columns, producers, requested)
            if rows is not None:
                self._overwrite(rows, laid_out=True)

    def merge(self, updates: DataFrame, producers: list[str] | None = None) -> None:
        """Column mode on the stored table.

        With a ``source_id`` column in ``updates`` only the buckets of those
        sources are read and rewritten; ``producers`` narrows it further.
        """
        with scratch_tables(self.spark):
            self._merge(updates, producers)

    def _merge(self, updates: DataFrame, producers: list[str] | None) -> None:
        stored = self._stored()
        if producers is not None:
            stored = stored.where(F.col("producer_asset").isin(producers))
        if "source_id" in updates.columns:
            updates = materialize(updates, "updates")
            stored = stored.where(self._bucket_in(updates))
            updates = updates.drop("source_id")
        self._overwrite(merge_columns(stored, updates))
