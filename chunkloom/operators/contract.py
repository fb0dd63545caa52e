"""The contract of an operator, and a ledger that makes runs again skip what is done.

An operator names its configuration and its output; both are checked before any row is read.  Errors say whether
trying again may help.  The ledger has a line for every (operator, version, configuration, source) that was
finished; a run leaves these out, so running again over finished sources reads no chunk.  Lines are
appended after the rows are stored: a run that dies between the two is done again, with the same result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.operators.assets import original_chunks
from chunkloom.schema import CHUNKS_ASSET, config_hash
from chunkloom.session import materialize, scratch_tables
from chunkloom.sources import hadoop
from chunkloom.sources.chunk_table import ChunkTable

LEDGER = "operator string, version string, config_hash string, source_id bigint, done boolean, run bigint"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


class OperatorError(RuntimeError):
    """``retryable``: whether the same run may succeed later."""

    retryable = False


class ConfigError(OperatorError):
    """The configuration does not fit the operator."""


class OutputError(OperatorError):
    """The operator's output is not what it names."""


class UnavailableError(OperatorError):
    """Something the operator needs is not there now."""

    retryable = True


@dataclass(frozen=True)
class Operator:
    """``process`` turns chunks into rows of ``output``: columns by ``chunk_id`` (tagger) or chunk rows (augmenter).

    A tagger that needs no other row gives ``columns`` instead, by name for a configuration: these are set where
    the rows lie, without a join or an exchange.  ``config`` describes each setting by ``type`` and, where wanted, ``minimum``, ``maximum``, ``enum`` and
    ``default``; settings without a default are required.
    """

    name: str
    version: str
    category: Literal["tagger", "augmenter"]
    config: dict[str, dict]
    output: T.StructType
    process: Callable[[DataFrame, dict], DataFrame] | None = None
    health_check: Callable[[], bool] = field(default=lambda: True)
    columns: Callable[[dict], dict[str, Column]] | None = None


def checked_config(operator: Operator, config: dict) -> dict:
    """The configuration with defaults, or what is wrong with it."""
    unknown = config.keys() - operator.config.keys()
    if unknown:
        raise ConfigError(f"{operator.name} has no setting {', '.join(sorted(unknown))}")
    out = {}
    for name, rule in operator.config.items():
        if name not in config and "default" not in rule:
            raise ConfigError(f"{operator.name} needs the setting {name}")
        value = out[name] = config.get(name, rule.get("default"))
        kind = rule.get("type")
        if kind and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind != "boolean")):
            raise ConfigError(f"{name} must be of type {kind}")
        if "enum" in rule and value not in rule["enum"]:
            raise ConfigError(f"{name} must be one of {rule['enum']}")
        if ("minimum" in rule and value < rule["minimum"]) or ("maximum" in rule and value > rule["maximum"]):
            raise ConfigError(f"{name} lies outside its bounds")
    return out


def checked_output(operator: Operator, rows: DataFrame) -> DataFrame:
    """The rows, if their columns and types are the ones named."""
    want = {f.name: f.dataType.simpleString() for f in operator.output.fields}
    have = dict(rows.dtypes)
    if have != want:
        differ = sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))
        raise OutputError(f"{operator.name} gives other columns than it names: {', '.join(differ)}")
    if operator.category == "tagger" and "chunk_id" not in want:
        raise OutputError("a tagger's output has a chunk_id")
    return rows


@dataclass(frozen=True)
class Ledger:
    """Finished work, as lines appended to a Parquet table; the latest line of a key counts."""

    spark: SparkSession
    path: str

    def _lines(self) -> DataFrame:
        if not hadoop.has_data(self.spark, self.path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def finished(self, operator: Operator, config: dict) -> DataFrame:
        """(source_id) done by this operator in this version with this configuration."""
        mine = self._lines().where(
            (F.col("operator") == operator.name) & (F.col("version") == operator.version) & (F.col("config_hash") == config_hash(config))
        )
        latest = mine.groupBy("source_id").agg(F.max_by("done", F.struct("run", ~F.col("done"))).alias("done"))
        return latest.where("done").select("source_id")

    def note(self, operator: Operator, config: dict, sources: DataFrame) -> None:
        """``sources(source_id)`` are done."""
        key = [F.lit(operator.name), F.lit(operator.version), F.lit(config_hash(config))]
        self._append(sources.select(*key, "source_id", F.lit(True)))

    def forget(self, sources: DataFrame) -> None:
        """The chunks of ``sources(source_id)`` are new: nothing that was done with them counts any more."""
        known = self._lines().select("operator", "version", "config_hash", "source_id").distinct()
        self._append(known.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("operator", "version", "config_hash", "source_id", F.lit(False)))

    def _append(self, lines: DataFrame) -> None:
        stamped = lines.toDF("operator", "version", "config_hash", "source_id", "done").withColumn("run", F.lit(time.time_ns()))
        stamped.write.mode("append").parquet(self.path)


def run_operator(operator: Operator, table: ChunkTable, ledger: Ledger, config: dict, requested: DataFrame) -> int:
    """Run over the ``requested(id)`` sources that are not finished; how many these were.

    Only the buckets of these sources are read and written.
    """
    settings = checked_config(operator, config)
    if not operator.health_check():
        raise UnavailableError(f"{operator.name} is not ready")
    wanted = requested.select(F.col("id").alias("source_id")).distinct()
    with scratch_tables(table.spark):
        pending = materialize(wanted.join(ledger.finished(operator, settings), "source_id", "left_anti"), "pending")
        count = pending.count()
        if count == 0:
            return 0
        chunks = original_chunks(table.read(pending.withColumnRenamed("source_id", "id")))
        columns = operator.columns(settings) if operator.columns else None
        if columns is not None:
            rows = chunks.select("chunk_id", *[made.alias(name) for name, made in columns.items()])
        else:
            rows = operator.process(chunks, settings)
        checked_output(operator, rows)
        if columns is not None:
            table.set_columns(columns, [CHUNKS_ASSET], pending.withColumnRenamed("source_id", "id"))
        elif operator.category == "tagger":
            table.merge(rows, producers=[CHUNKS_ASSET])
        else:
            table.replace_rows(rows)
        ledger.note(operator, settings, pending)
    return count
