"""Nearest neighbours by collision-counting hashing.

Each block of vectors is indexed by one sorted array per random projection. A query opens a window
around its own projection in every array and widens all windows by virtual rehashing; a vector
that enough windows have met is verified with its true distance. At radius R the windows reach
``REACH * R`` to both sides, and a vector within R fails to meet the threshold with a chance of
about 2 %. A query ends at the first radius that holds k verified neighbours, so there is no cap
on candidates. Queries meet vectors block by block; what leaves a pair of blocks is k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutframe.session import written

PROJECTIONS = 128
REACH = 1.0  # half a window, in radii
GROWTH = 1.25  # of the radius from round to round
#: Standard deviations that the collision threshold lies below the mean of a vector at distance R.
MARGIN = 2.0
SEED = 7
#: A block holds at most so many bytes of vectors, and small tables make a few blocks for each core.
BLOCK_BYTES, QUERY_BYTES, LEAST_ROWS, BLOCKS_PER_CORE, MOST_PARTS = 16 << 20, 4 << 20, 4096, 2, 20_000

def threshold(projections: int = PROJECTIONS, reach: float = REACH, margin: float = MARGIN) -> int:
    """Collisions asked of a candidate: a vector at distance R has them in all but 2 % of cases."""
    p = erf(reach / sqrt(2))
    return max(1, int(projections * p - margin * sqrt(projections * p * (1 - p))))


class Index:
    """Sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.ids, self.vectors, self.projections = ids, vectors, projections
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        keys = (vectors.astype(np.float64) @ self.lines).T
        order = np.argsort(keys, axis=1, kind="stable")
        self.order = order.astype(np.uint16 if len(ids) < 1 << 16 else np.int64)
        self.keys = np.take_along_axis(keys, order, axis=1)
        spread = float(np.median(keys.std(axis=1))) if len(ids) else 0.0
        self.first_radius = spread / 4 or 1.0

    def search(self, own_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and distances of its k nearest of the block, but its own id."""
        places = queries.astype(np.float64) @ self.lines
        rounds: list[tuple[float, np.ndarray, np.ndarray]] = []  # radius, and windows of all queries
        out = []
        for i in range(len(queries)):
            out.append(self._one(own_ids[i], queries[i].astype(np.float64), i, places, rounds, k))
        return out

    def _windows(self, rounds: list, n: int, places: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        while len(rounds) <= n:
            radius = self.first_radius * GROWTH ** len(rounds)
            low, high = places - REACH * radius, places + REACH * radius
            lo = np.stack([np.searchsorted(keys, x, "left") for keys, x in zip(self.keys, low.T)], axis=1)
            hi = np.stack([np.searchsorted(keys, x, "right") for keys, x in zip(self.keys, high.T)], axis=1)
            rounds.append((radius, lo, hi))
        return rounds[n]

    def _one(self, own, query, i, places, rounds, k) -> tuple[np.ndarray, np.ndarray]:
        size, asked = len(self.ids), threshold(self.projections)
        counts, verified = np.zeros(size, np.int32), np.zeros(size, bool)
        ids, scores, n, before = np.empty(0, self.ids.dtype), np.empty(0), 0, None
        while True:
            radius, lows, highs = self._windows(rounds, n, places)
            lo, hi = lows[i], highs[i]
            if before is None:
                new = [o[a:b] for o, a, b in zip(self.order, lo, hi)]
            else:
                new = [o[a:b] for o, a, b in zip(self.order, lo, before[0])]
                new += [o[a:b] for o, a, b in zip(self.order, before[1], hi)]
            counts += np.bincount(np.concatenate(new), minlength=size).astype(np.int32)
            found = np.flatnonzero((counts >= asked) & ~verified)
            verified[found] = True
            found = found[self.ids[found] != own]
            distance = np.sqrt(np.square(self.vectors[found].astype(np.float64) - query).sum(axis=1))
            ids, scores = np.concatenate([ids, self.ids[found]]), np.concatenate([scores, distance])
            # Windows over all rows have verified every vector.
            if (scores <= radius).sum() >= k or (hi - lo).min() == size:
                best = np.lexsort((ids, scores))[:k]
                return ids[best], scores[best]
            before, n = (lo, hi), n + 1


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k nearest rows of ``vectors`` of each row of ``queries``, by Euclidean distance.

    Returns query_id, rank (from 1), vec_id and score, nearest first and ties to smaller ids; with
    fewer candidates all of them. Rows with a query's own id are no candidates of it. Vectors that
    are null, zero, empty or hold null or non-finite components take no part, nor do rows without
    an id; vectors of different length never meet. Rows repeating an id count once. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    usable = written(_usable(vectors, id_col, vector_col).dropDuplicates(["id"]), "nearest-vectors")
    asked = written(_usable(queries, id_col, vector_col).dropDuplicates(["id"]), "nearest-asked")
    total, dim = usable.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    cores = spark.sparkContext.defaultParallelism
    most = max(1, BLOCK_BYTES // (8 * dim))
    rows = min(most, max(LEAST_ROWS, -(-total // (BLOCKS_PER_CORE * cores))))
    blocks = written(_blocks(usable, total, rows), "nearest-blocks")
    query_blocks = written(_blocks(asked, asked.count(), max(1, QUERY_BYTES // (8 * dim))), "nearest-queries")

    # Each vector block moves once, followed by a copy of every query block of its dimension.
    held = blocks.select(F.col("block").alias("vector_block"), F.lit(0).alias("kind"), "dim", "ids", "vectors")
    places = blocks.select(F.col("dim").alias("of_dim"), F.col("block").alias("vector_block"))
    copies = query_blocks.join(places, F.col("dim") == F.col("of_dim"))
    copies = copies.select("vector_block", F.lit(1).alias("kind"), "dim", "ids", "vectors")
    n = min(MOST_PARTS, max(1, blocks.count()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    ordered = held.unionByName(copies).repartition(n, "vector_block").sortWithinPartitions("vector_block", "kind")
    found = ordered.mapInArrow(_searcher(k), "query_id long, vec_id long, score double")
    nth = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return kept.filter(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.expr("exists(v, x -> x <> 0)"))


def _blocks(rows: DataFrame, total: int, size: int) -> DataFrame:
    """The ``total`` rows packed in blocks of at most ``size`` vectors of one dimension."""
    n = min(MOST_PARTS, max(1, -(-total // size)))
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    packed = rows.repartition(n).mapInArrow(_packer(size), "dim int, ids binary, vectors binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(dim, rows):
            ids = np.array([i for i, _ in rows], "<i8").tobytes()
            values = np.stack([v for _, v in rows]).astype("<f8").tobytes()
            columns = [pa.array([dim], pa.int32()), pa.array([ids], pa.binary()), pa.array([values], pa.binary())]
            return pa.record_batch(columns, names=["dim", "ids", "vectors"])

        for batch in batches:
            flat = batch.column("v")
            values, at = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
            for i, a, b in zip(batch.column("id").to_pylist(), at[:-1], at[1:]):
                rows = held.setdefault(int(b - a), [])
                rows.append((i, values[a:b]))
                if len(rows) == size:
                    yield out(int(b - a), held.pop(int(b - a)))
        for dim, rows in held.items():
            yield out(dim, rows)

    return pack


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                if row["kind"] == 0:  # a block comes before its queries
                    index = Index(ids, vectors)
                    continue
                own, found = ids, index.search(ids, vectors, k)
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(own, [len(ids) for ids, _ in found])),
                        pa.array(np.concatenate([ids for ids, _ in found])),
                        pa.array(np.concatenate([s for _, s in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return search
