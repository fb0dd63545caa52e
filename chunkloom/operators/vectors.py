"""Nearest neighbours by cosine: an index of cells, probing, exact scores.

Centroids are fitted on a bounded sample; every row is assigned to its nearest one and
stored in blocks of rows of one cell.  A search deals each query to the cells it probes, meets blocks of
rows with blocks of queries, scores them exactly by one matrix product, keeps the best of each block, and
merges these by a rank that Spark limits in every task before the shuffle.  ``probes=None`` compares
with all rows.

Scores are cosines in double precision, rounded to nine decimals; equal scores are ordered by id.  A vector that is
null, zero, of another length than the index, or holds null or non-finite values is neither found nor searched for.
A cell of any size is many blocks, which adaptive execution splits over tasks.  Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.session import materialize, tune

MOST_CELLS = 1024
# Sampled vectors the centroids are fitted on, for each cell, and queries that set the probes.
SAMPLE_PER_CELL = 32
TRIAL_QUERIES = 256
# Expected share of true neighbours in the probed cells.
RECALL = 0.98
ROUNDS = 8
ROWS_PER_BLOCK = 1024
QUERIES_PER_BLOCK = 256
# Exact searches deal rows to so many lanes, and each query to all of them.
LANES = 32
DECIMALS = 9
PACKED = "cell int, ids array<long>, matrix binary"


def clean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of rows whose vector has a direction."""
    values = F.col(f"`{vector}`").cast("array<float>")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), values.alias("vector")).where(
        F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull()
    )


def _matrix(column):
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def _unit(matrix):
    import numpy as np

    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _centroids(sample, cells: int, seed: int):
    """Spherical k-means over unit rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def _probes_for(sample, centres, k: int, recall: float) -> int:
    """Least number of cells that hold ``recall`` of the sample's own neighbours.

    The sample is sparser than the table, so its neighbours lie farther off and ask for more cells.
    """
    import numpy as np

    trial = sample[:TRIAL_QUERIES]
    scores = trial @ sample.T
    np.fill_diagonal(scores, -2)
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    home = (sample @ centres.T).argmax(axis=1)
    order = np.argsort(np.argsort(-(trial @ centres.T), axis=1), axis=1)
    places = np.sort(np.take_along_axis(order, home[near], axis=1).ravel())
    return 1 if len(places) == 0 else int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1


def _assign(rows: DataFrame, centres, probes: int) -> DataFrame:
    """(cell, id, vector) for the nearest ``probes`` cells of each row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = batch.column("vector")
            near = _unit(_matrix(vectors)) @ centres.T
            cells = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel().astype(np.int32)), batch.column("id").take(at), vectors.take(at)], ["cell", "id", "vector"]
            )

    return rows.mapInArrow(run, "cell int, id long, vector array<float>")


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """``rows(cell, id, vector)`` as blocks of at most ``most`` rows of one cell."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            bounds = [0, *cuts.tolist(), len(cells)]
            starts = [(s, min(s + most, b)) for a, b in zip(bounds, bounds[1:]) for s in range(a, b, most)]
            ids = batch.column("id").to_numpy()
            matrix = _matrix(batch.column("vector")).astype(np.float32) if len(cells) else None
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([cells[a] for a, _ in starts], pa.int32()),
                    pa.array([ids[a:b] for a, b in starts], pa.list_(pa.int64())),
                    pa.array([matrix[a:b].tobytes() for a, b in starts], pa.binary()),
                ],
                ["cell", "ids", "matrix"],
            )

    return rows.hint("rebalance", "cell").sortWithinPartitions("cell").mapInArrow(run, PACKED)


def _best_of_blocks(pairs: DataFrame, k: int, width: int, skip_self: bool) -> DataFrame:
    """Best ``k`` of each block of rows for each query of the block it met."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def read(batch, i, ids, matrix):
            values = np.frombuffer(batch.column(matrix)[i].as_buffer(), np.float32).reshape(-1, width)
            return batch.column(ids)[i].values.to_numpy(), _unit(values.astype(np.float64))

        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                row_ids, rows = read(batch, i, "ids", "matrix")
                query_ids, queries = read(batch, i, "query_ids", "query_matrix")
                scores = np.round(queries @ rows.T, DECIMALS) + 0.0
                if skip_self:
                    scores[query_ids[:, None] == row_ids[None, :]] = -np.inf
                if len(row_ids) > k:
                    least = np.partition(scores, -k, axis=1)[:, -k]
                else:
                    least = np.full(len(query_ids), -2.0)
                # All that tie with the last place stay; the rank by id decides.
                q, r = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
                order = np.lexsort((row_ids[r], -scores[q, r], q))
                q, r = q[order], r[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, r = q[place < k], r[place < k]
                found.append((query_ids[q], row_ids[r], scores[q, r]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "id", "score"])

    return pairs.select("ids", "matrix", "query_ids", "query_matrix").mapInArrow(run, "query_id long, id long, score double")


@dataclass(frozen=True)
class VectorIndex:
    """Blocks of rows by cell at ``path``, and the centroids."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(
        rows: DataFrame, path: str, *, key: str = "id", vector: str = "vector", cells: int | None = None, k: int = 10, recall: float = RECALL, seed: int = 0
    ) -> VectorIndex:
        """Index every row with a usable vector.

        Without ``cells`` their number is the root of the number of rows, at most
        ``MOST_CELLS``; at most ``SAMPLE_PER_CELL`` vectors a cell are fitted on, drawn by a hash of the id.  The number
        of cells a search probes follows from the sample, ``k`` and ``recall``.
        """
        import numpy as np

        spark = tune(rows.sparkSession)
        usable = clean(rows, key, vector)
        total, shortest, longest = usable.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if shortest != longest:
            raise ValueError(f"vectors of {shortest} and of {longest} values")
        cells = min(MOST_CELLS, cells or max(1, math.isqrt(total)))
        most = max(TRIAL_QUERIES, cells * SAMPLE_PER_CELL)
        share = min(1.0, 1.2 * most / max(1, total))
        drawn = usable.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(most).collect()
        if total and not drawn:
            drawn = usable.limit(most).collect()
        # The draw's order depends on the scan; the fit must not.
        sample = np.array([r.vector for r in sorted(drawn)], np.float64).reshape(len(drawn), longest or 0)
        sample = _unit(sample) if len(sample) else sample
        np.random.default_rng(seed).shuffle(sample)
        centres = _centroids(sample, cells, seed) if len(sample) else sample
        probes = _probes_for(sample, centres, k, recall) if len(sample) else 1
        noted = [(i, probes, longest, c.tolist()) for i, c in enumerate(centres)]
        spark.createDataFrame(noted, "cell int, probes int, width int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        blocks = _packed(_assign(usable, centres, 1), ROWS_PER_BLOCK) if noted else spark.createDataFrame([], PACKED)
        blocks.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
        return VectorIndex(spark, path)

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(f"{self.path}/blocks")

    def search(self, queries: DataFrame, k: int, *, key: str = "id", vector: str = "vector", probes: int | None = -1, skip_self: bool = True) -> DataFrame:
        """(query_id, rank from 1, id, score) of the ``k`` nearest rows of each query.

        ``probes`` cells are looked into (by default as many as the index was built for), or, if it is None, all rows.
        """
        import numpy as np

        centroids = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        if not centroids:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, score double")
        centres, width = np.array([r.centre for r in centroids]), centroids[0].width
        probes = centroids[0].probes if probes == -1 else probes
        asked = clean(queries, key, vector).where(F.size("vector") == width)
        if probes is None:
            lanes = min(LANES, len(centres))
            dealt = asked.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("cell"), "id", "vector")
            blocks = self.blocks().withColumn("cell", F.col("cell") % lanes)
        else:
            dealt = _assign(asked, centres, probes)
            blocks = self.blocks()
        packed = materialize(_packed(dealt, QUERIES_PER_BLOCK), "queries")
        if probes is not None:
            # At most as many numbers as there are cells; as literals they prune the scan.
            wanted = [r.cell for r in packed.select("cell").distinct().collect()]
            blocks = blocks.where(F.col("cell").isin(wanted))
        pairs = blocks.join(packed.select("cell", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix")), "cell")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return (
            _best_of_blocks(pairs, k, width, skip_self)
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score")
        )


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return hits / max(1, exact.count())
