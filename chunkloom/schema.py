"""The chunk table's schema and naming rules."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names, order and types of the chunk table, and its conventions.
_FIELDS: list[tuple[str, T.DataType]] = [
    ("chunk_id", T.StringType()),
    ("source_id", T.LongType()),
    ("source_collection_id", T.LongType()),
    ("producer_asset", T.StringType()),
    ("producer_version", T.StringType()),
    ("text", T.StringType()),
    ("token_count", T.IntegerType()),
    ("docling_refs", T.StringType()),
    ("source_refs", T.StringType()),
    ("augmented_from", T.StringType()),
    ("augmenter_id", T.StringType()),
    ("augmenter_config_hash", T.StringType()),
    ("attr_quality_score", T.FloatType()),
    ("attr_quality_provider", T.StringType()),
    ("attr_lang_code", T.StringType()),
    ("attr_lang_confidence", T.FloatType()),
    ("attr_minhash_signature", T.ArrayType(T.LongType())),
    ("attr_minhash_cluster_id", T.LongType()),
    ("attr_minhash_is_head", T.BooleanType()),
    ("attr_pii_has_pii", T.BooleanType()),
    ("attr_pii_categories", T.ArrayType(T.StringType())),
    ("attr_embed_vector", T.ArrayType(T.FloatType())),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
]
CHUNKS_ASSET = "chunks"
CHUNKER_VERSION = "0.1.0"
TOKEN_BUDGET = 512
EXTRACTOR_NAME = "mineru"
EXTRACTOR_VERSION = "0.1.0"

CHUNK_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _FIELDS])
CHUNK_COLUMNS: list[str] = CHUNK_SCHEMA.fieldNames()


def conform(df: DataFrame) -> DataFrame:
    """Project ``df`` onto the chunk schema; absent columns become NULL.

    Attribute columns beyond the base schema (the table grows by adding
    columns) follow the base columns unchanged.
    """
    columns = df.columns
    have = set(columns)
    base = [
        f"CAST({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in CHUNK_SCHEMA.fields
    ]
    return df.selectExpr(*base, *[f"`{c}`" for c in columns if c not in CHUNK_COLUMNS])


def config_hash(config: dict) -> str:
    """sha256 of the canonical (sorted, compact) JSON of an operator config."""
    canonical = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(canonical.encode()).hexdigest()
