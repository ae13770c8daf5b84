"""Approximate nearest neighbours by collision counting over sorted single projections.

Vectors are scaled to length one and projected on random orthogonal directions. A block of vectors keeps, for each direction,
its values in sorted order. Around a query's value a window is opened in every order and widened step by step (virtual
rehashing); a vector that lies in enough windows is verified by its exact cosine. Widening ends for a query when vectors
nearer than the worst of its best ``k`` would be expected in more than enough windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.workspace import stage


APART = 8.0


@dataclass(frozen=True)
class NeighbourSettings:
    """``directions`` projections (at most the dimension); a vector in ``share`` of the windows is verified. ``sureness``
    are the standard deviations by which the expected collisions of the ``k``-th neighbour must exceed that before a query
    stops; ``first`` is half the first window and ``widen`` its growth. Blocks hold about ``block`` vectors or queries."""

    k: int = 5
    directions: int = 64
    share: float = 0.5
    sureness: float = 1.5
    first: float = 0.04
    widen: float = 1.5
    block: int = 8192
    seed: int = 11


def directions(dimension: int, settings: NeighbourSettings) -> np.ndarray:
    """Orthonormal random directions, one per column; the same in every task."""
    square = np.random.default_rng(settings.seed).standard_normal((dimension, dimension))
    basis, upper = np.linalg.qr(square)
    return (basis * np.sign(np.diag(upper)))[:, : min(settings.directions, dimension)]


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision; rows with equal numbers give equal results wherever they stand."""
    dots = (vectors * query).sum(axis=1)
    return dots / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


class Block:
    """Sorted projections of one block of vectors (double precision, one per row) with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, settings: NeighbourSettings):
        self.ids, self.vectors, self.settings = ids, vectors, settings
        self.basis = directions(vectors.shape[1], settings)
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / self.lengths[:, None]
        values = self.unit @ self.basis
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).ravel()
        # all sorted arrays end to end, kept apart by adding APART times the direction: one search serves all
        self.apart = APART * np.arange(values.shape[1])
        self.sorted = (np.sort(values, axis=0).T + self.apart[:, None]).ravel()

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray) -> list[tuple[int, int, float]]:
        """``(query id, vector id, cosine)`` of the best ``k`` found for each query, best first."""
        count, size = len(self.apart), len(self.ids)
        spots = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ self.basis
        need = max(1, math.ceil(self.settings.share * count))
        p = self.settings.share
        enough = min(p + self.settings.sureness * math.sqrt(p * (1 - p) / count), 0.99)
        reach = _quantile(enough) / math.sqrt(self.vectors.shape[1])
        out: list[tuple[int, int, float]] = []
        for own, query, spot in zip(query_ids.tolist(), queries, spots + self.apart):
            width = self.settings.first
            low = high = np.searchsorted(self.sorted, spot)
            hits, seen, best = np.zeros(size, np.int64), np.zeros(size, bool), []
            while True:
                a = np.minimum(np.searchsorted(self.sorted, spot - width), low)
                b = np.maximum(np.searchsorted(self.sorted, spot + width, side="right"), high)
                ends = zip(a.tolist(), low.tolist(), high.tolist(), b.tolist())
                fresh = [self.order[x:y] for i, j, k, m in ends for x, y in ((i, j), (k, m)) if y > x]
                low, high = a, b
                if fresh:
                    hits += np.bincount(np.concatenate(fresh), minlength=size)
                best = self._verify(own, query, np.flatnonzero((hits >= need) & ~seen), best)
                seen |= hits >= need
                if len(best) == self.settings.k:
                    distance = math.sqrt(max(0.0, 2.0 + 2.0 * best[-1][0]))
                    if width >= reach * distance:
                        break
                if seen.all() or width > 2.0:
                    break
                width *= self.settings.widen
            out += [(own, i, -score) for score, i in best]
        return out

    def _verify(self, own: int, query: np.ndarray, fresh: np.ndarray, best: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """``best`` with those of the vectors at ``fresh`` that belong to it. A fast product leaves out what is clearly
        worse; the rest gets exact cosines."""
        fresh = fresh[self.ids[fresh] != own]
        if not len(fresh):
            return best
        k = self.settings.k
        rough = self.unit[fresh] @ (query / np.sqrt((query * query).sum()))
        floor = np.partition(rough, -k)[-k] if len(rough) > k else -2.0
        if len(best) == k:
            floor = max(floor, -best[-1][0])
        fresh = fresh[rough >= floor - 1e-9]
        if len(fresh):
            scores = cosines(query, self.vectors[fresh])
            keep = np.lexsort((self.ids[fresh], -scores))[:k]
            best = sorted(best + [(-scores[i], int(self.ids[fresh[i]])) for i in keep.tolist()])[:k]
        return best


def _quantile(p: float) -> float:
    """``x`` with a standard normal value inside ``-x..x`` with probability ``p``."""
    low, high = 0.0, 6.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erf(middle / math.sqrt(2)) < p else (low, middle)
    return high


def usable_vectors(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id, v, dim`` of rows with an id and a vector that is not null, not zero and has finite components only."""
    v = F.col(column).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound & some, F.lit(False))).withColumn(
        "dim", F.size("v")
    )


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row per block and dimension: ``dim, name, ids, data`` as packed arrays of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, dim, block = [], [], None, None
        for batch in batches:
            if batch.num_rows:
                dim, block = batch.column("dim")[0], batch.column("block")[0]
                ids.append(batch.column("id").to_numpy().astype(np.int64).tobytes())
                data.append(batch.column("v").flatten().to_numpy().tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim.as_py()], pa.int32()), pa.array([block.as_py()], pa.int64()),
                 pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(data)], pa.binary())],
                ["dim", name, "ids", "data"],
            )

    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    return placed.groupBy("dim", "block").applyInArrow(run, f"dim int, {name} long, ids binary, data binary")


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, id_column: str, column: str, settings: NeighbourSettings | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` vectors of largest cosine found among all rows
    of ``vectors`` with another id, nearest first, ties to the smaller id; all of them if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, on either side, nor do rows without
    an id; only vectors of a query's dimension are compared with it. Rows that share an id give one result with their best
    score. Equal vectors are all found together. Every block of queries meets every block of vectors, in sorted
    blocks of bounded size; what is compared inside is what the windows let through. Empty tables give no rows.
    """
    settings = settings or NeighbourSettings()
    every = stage(usable_vectors(vectors, id_column, column), "vectors")
    asked = stage(usable_vectors(queries, id_column, column), "queries")
    blocks, groups = (max(1, -(-t.count() // settings.block)) for t in (every, asked))
    left = stage(_packed(every, blocks, "block"), "blocks")
    right = stage(_packed(asked, groups, "group"), "groups").toDF("dim", "group", "query_ids", "query_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                ids, query_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("ids", "query_ids"))
                data, query_data = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("data", "query_data")
                )
                rows = Block(ids, data, settings).nearest(query_ids, query_data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    pairs = left.join(right, "dim").repartition(F.col("block"), F.col("group"))
    found = pairs.select("dim", "ids", "data", "query_ids", "query_data").mapInArrow(
        run, "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= settings.k).select("query_id", "rank", "vec_id", "score")


def op6_collision_counting(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding")


QUERIES = {"op6_collision_counting": op6_collision_counting}
SQL = {}
