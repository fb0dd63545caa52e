"""Publishing a data set: Parquet splits with sidecar files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.sources import hadoop

# Splits, columns and the shape of the info sidecar.
SPLITS = ("train", "validation")
COLUMNS = ("instruction", "output", "chunk_id")
# Fixed value: the card of a data set that was given none.
STUB_CARD = "# Dataset {name}\n\nGenerated by sft_synthesis_qa.\n"


def dataset_infos(splits: dict[str, tuple[int, int]]) -> dict:
    """Info sidecar from {split: (num_bytes, num_examples)}."""
    size = sum(num_bytes for num_bytes, _ in splits.values())
    return {
        "default": {
            "description": "",
            "citation": "",
            "homepage": "",
            "license": "",
            "features": {c: {"dtype": "string", "_type": "Value"} for c in COLUMNS},
            "splits": {
                name: {
                    "name": name,
                    "num_bytes": num_bytes,
                    "num_examples": num_examples,
                    "dataset_name": "default",
                }
                for name, (num_bytes, num_examples) in splits.items()
            },
            "download_size": size,
            "dataset_size": size,
        }
    }


def write_dataset(
    rows: DataFrame,
    root: str,
    dataset_id: int,
    version_tag: str,
    recipe: dict,
    card: str | None = None,
) -> dict:
    """Write ``rows(split, instruction, output, chunk_id)`` as a data set.

    One Spark write puts both splits into a staging folder beside the data, on the same
    file system; its part files are named ``{split}-00000.parquet`` and so on in a new
    folder, which then takes the place of ``data`` by a rename.  Until then the
    earlier data stay as they are.  A split without rows still gets one empty
    file.  Returns the counts for the catalog.
    """
    spark = rows.sparkSession
    prefix = f"{dataset_id}_{version_tag}"
    target = f"{root}/{prefix}"
    staging = f"{target}/_staging-{uuid.uuid4().hex}"
    fresh, replaced = f"{staging}/data", f"{staging}/replaced"
    (
        rows.select("split", *COLUMNS)
        .hint("rebalance", "split")
        .write.partitionBy("split")
        .parquet(f"{staging}/rows")
    )
    sizes: dict[str, tuple[int, int]] = {}
    for split in SPLITS:
        files = hadoop.listing(spark, f"{staging}/rows/split={split}", ".parquet")
        if not files:
            empty = f"{staging}/empty-{split}"
            rows.select(*COLUMNS).limit(0).coalesce(1).write.parquet(empty)
            files = hadoop.listing(spark, empty, ".parquet")
        for i, (path, _) in enumerate(files):
            hadoop.rename(spark, path, f"{fresh}/{split}-{i:05d}.parquet")
        num_rows = spark.read.parquet(f"{fresh}/{split}-*.parquet").count()
        sizes[split] = (sum(size for _, size in files), num_rows)
    if hadoop.exists(spark, f"{target}/data"):
        hadoop.rename(spark, f"{target}/data", replaced)
    hadoop.rename(spark, fresh, f"{target}/data")
    hadoop.delete(spark, staging)
    hadoop.write_text(
        spark, f"{target}/recipe.json", json.dumps(recipe, ensure_ascii=False, indent=2)
    )
    hadoop.write_text(
        spark,
        f"{target}/README.md",
        card if card is not None else STUB_CARD.format(name=prefix),
    )
    hadoop.write_text(
        spark,
        f"{target}/dataset_infos.json",
        json.dumps(dataset_infos(sizes), ensure_ascii=False, indent=2),
    )
    return {
        "dataset_id": dataset_id,
        "sample_count": sum(n for _, n in sizes.values()),
        "size_bytes": sum(b for b, _ in sizes.values()),
        "path": target,
    }


def read_splits(spark, path: str) -> DataFrame:
    """All rows of a published data set with their split."""
    parts = [
        spark.read.parquet(f"{path}/data/{s}-*.parquet").withColumn("split", F.lit(s))
        for s in SPLITS
    ]
    return parts[0].unionByName(parts[1])
