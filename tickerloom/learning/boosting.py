"""Boosted trees grown on histograms, for many sets of rows at once.

A set is a mask over the rows of one table, given as a weight per set: nested sets, such as all rows older than one day or
another, share every pass. Features are cut into at most 64 bins once per set, from that set's rows only. One level of the
trees of all sets and all outputs is one job: tasks add the gradients of their rows into histograms of a fixed size (set,
output, node, feature, bin), the histograms of each set and output meet in one task, which adds them and picks the splits. The
driver gets the splits alone: nothing on it grows with the rows or with the tasks.

Tasks read chunks of rows from a stored table and bring their scores up to date with the few trees grown since the scores
were last checkpointed, so a lost executor costs its own chunks only.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.features import FEATURES
from tickerloom.workspace import shared_dir, stage

# Functions that run in tasks travel with them, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_ROWS = 16_384
TASK_ROWS = 500_000
NO_SPLIT = 255
STEP_BITS = 20  # gradients are multiples of 2**-20, so that sums of doubles do not depend on their order
SKETCH = 1_000


@dataclass(frozen=True)
class Growth:
    rounds: int
    step: float
    depth: int
    min_leaf: int = 1
    bins: int = 64
    store_every: int = 10


class Chunk(NamedTuple):
    """Rows of one set: its number, bins by feature, target, weight, key for drawing, and score by output."""

    set: int
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    draw: np.ndarray
    score: np.ndarray


class Trees(NamedTuple):
    """One tree per set and output in heap order: feature and last bin that goes left of each split, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class Forest:
    """Fitted trees of all sets and outputs: ``base[set, output]``, and ``feature, threshold, value[set, output, round]``."""

    base: np.ndarray
    step: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    fitted: np.ndarray  # which sets had rows

    def scores(self, x: np.ndarray, number: int) -> np.ndarray:
        """Outputs of one set for a matrix of feature rows; a missing value goes left."""
        outputs, rounds, splits = self.feature.shape[1:]
        if not rounds:
            return np.repeat(self.base[number][None], len(x), axis=0)
        feature, threshold = (a[number].reshape(-1, splits) for a in (self.feature, self.threshold))
        value = self.value[number].reshape(outputs * rounds, -1)
        tree, row = np.arange(outputs * rounds), np.arange(len(x))[:, None]
        node = np.zeros((len(x), outputs * rounds), np.int32)
        for _ in range(int(math.log2(splits + 1))):
            node = 2 * node + 1 + (x[row, feature[tree, node]] > threshold[tree, node])
        out = value[tree, node - splits].reshape(len(x), outputs, rounds).sum(axis=2)
        return self.base[number] + self.step * out


class Softmax:
    """Classes by their number in ``y``. Leaves take a Newton step. A class without rows has no share."""

    def __init__(self, outputs: int):
        self.outputs = outputs

    def bases(self, rows: DataFrame, n_sets: int) -> np.ndarray:
        def weight(k: int, c: int):
            return F.coalesce(F.sum(F.when(F.col("y") == c, F.col("w")[k])), F.lit(0.0))

        found = rows.agg(*[weight(k, c).alias(f"b{k}_{c}") for k in range(n_sets) for c in range(self.outputs)]).first()
        sums = np.array(found, float).reshape(n_sets, self.outputs)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(sums / sums.sum(axis=1, keepdims=True))

    def shares(self, score: np.ndarray) -> np.ndarray:
        """Probabilities along the first axis."""
        high = np.exp(score - score.max(axis=0))
        return high / high.sum(axis=0)

    def gradients(self, chunk: Chunk, score: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        p = self.shares(score)
        hit = chunk.y == np.arange(self.outputs)[:, None]
        return chunk.w * (p - hit), chunk.w * p * (1 - p), None


class Quantiles:
    """One output per quantile. Trees follow the sign of the residual over rows drawn anew each round by their key; leaves take
    the quantile of the residuals in them, read from counts on a logarithmic grid (values good to 1 %)."""

    LEAST, RATIO, HALF = 1e-9, math.log(1.02), 1164

    def __init__(self, alphas: tuple[float, ...], share: float = 0.8, seed: int = 42):
        self.alphas, self.share, self.seed = np.array(alphas)[:, None], share, seed
        self.outputs = len(alphas)

    def bases(self, rows: DataFrame, n_sets: int) -> np.ndarray:
        asked = [float(a) for a in self.alphas[:, 0]]
        own = [F.percentile_approx(F.when(F.col("w")[k] > 0, F.col("y")), asked, 10_000).alias(f"b{k}") for k in range(n_sets)]
        return np.array([b if b is not None else [np.nan] * self.outputs for b in rows.agg(*own).first()], float)

    def gradients(self, chunk: Chunk, score: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        return -(self.alphas - (chunk.y <= score)), np.ones_like(score), self.drawn(chunk.draw, number)

    def drawn(self, draw: np.ndarray, number: int) -> np.ndarray:
        salt = (self.seed + 1000 * number) * 0x9E3779B97F4A7C15 % (1 << 64)
        x = draw.astype(np.uint64) + np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(40)) % np.uint64(1000)) < np.uint64(int(self.share * 1000))

    @property
    def places(self) -> int:
        return 2 * self.HALF + 1

    def place(self, residual: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            size = np.floor(np.log(np.abs(residual) / self.LEAST) / self.RATIO)
        size = np.clip(np.nan_to_num(size, neginf=-1), -1, self.HALF - 1).astype(np.int64) + 1
        return self.HALF + np.sign(residual).astype(np.int64) * size

    def middle(self, place: np.ndarray) -> np.ndarray:
        size = np.abs(place - self.HALF)
        return np.sign(place - self.HALF) * np.where(size > 0, self.LEAST * np.exp((size - 0.5) * self.RATIO), 0.0)

    def leaf_values(self, counts: np.ndarray, outputs: slice = slice(None)) -> np.ndarray:
        """From counts by (set, output, leaf, place) of some or all outputs; 0 for a leaf without rows."""
        upto = counts.cumsum(axis=-1)
        total = upto[..., -1:]
        wanted = np.maximum(np.ceil(self.alphas[None, outputs, :, None] * total), 1)
        found = self.middle((upto < wanted).sum(axis=-1))
        return np.where(total[..., 0] > 0, found, 0.0)


Loss = Softmax | Quantiles


def packed(rows: DataFrame) -> DataFrame:
    """Rows as a stored table of chunks."""
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, n // 1000 + 1), -(-n // TASK_ROWS))
    columns = [*FEATURES, "y", "draw", "w"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                x = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in FEATURES])
                y = part.column("y").to_numpy(zero_copy_only=False).astype(float)
                draw = part.column("draw").to_numpy(zero_copy_only=False).astype(np.int64)
                w = np.stack(part.column("w").to_numpy(zero_copy_only=False)).T
                values = [np.ascontiguousarray(a).tobytes() for a in (x, y, draw, w)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["x", "y", "draw", "w"])

    dealt = rows.select(*columns).repartition(parts, "draw").sortWithinPartitions("draw")
    return stage(dealt.mapInArrow(pack, "x binary, y binary, draw binary, w binary"), "chunks")


def feature_cuts(rows: DataFrame, n_sets: int, bins: int) -> np.ndarray:
    """Cuts by (set, feature), from sketches of each set's own rows; unused places are infinite."""
    asked = [k / bins for k in range(1, bins)]
    wanted = [
        F.percentile_approx(F.when(F.col("w")[k] > 0, F.col(c)), asked, SKETCH).alias(f"c{k}_{c}")
        for k in range(n_sets)
        for c in FEATURES
    ]
    found = rows.agg(*wanted).first()
    cuts = np.full((n_sets * len(FEATURES), bins - 1), np.inf)
    for row, values in zip(cuts, found):
        different = np.unique(np.array(values if values is not None else [], float))
        row[: len(different)] = different
    return cuts.reshape(n_sets, len(FEATURES), bins - 1)


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bins by feature; a missing value is in the lowest."""
    values = np.nan_to_num(values, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    return np.stack([np.searchsorted(c, v) for c, v in zip(cuts, values)]).astype(np.uint8)


def _split_sets(cuts: np.ndarray, bases: np.ndarray) -> Callable:
    n_sets, n_features = cuts.shape[:2]

    def run(row) -> Iterator[Chunk]:
        y, draw = np.frombuffer(row.y), np.frombuffer(row.draw, np.int64)
        x, w = np.frombuffer(row.x).reshape(n_features, -1), np.frombuffer(row.w).reshape(n_sets, -1)
        for k in range(n_sets):
            own = np.flatnonzero(w[k] > 0)
            if len(own):
                score = np.repeat(bases[k][:, None], len(own), axis=1)
                yield Chunk(k, binned(x[:, own], cuts[k]), y[own], w[k, own], draw[own], score)

    return run


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes of a level of one tree."""
    n, flat = x.shape[1], x.reshape(-1)
    node, row, begins = np.zeros(n, np.int64), np.arange(n), feature * n
    for _ in range(levels):
        above = flat.take(begins.take(node) + row) > cut.take(node)
        node = 2 * node + 1 + above
    return node - ((1 << levels) - 1)


def current_score(chunk: Chunk, recent: list[Trees], step: float) -> np.ndarray:
    score = chunk.score
    for trees in recent:
        depth = int(math.log2(trees.value.shape[-1]))
        score = score + step * np.stack(
            [
                value[walk(chunk.x, feature, cut, depth)]
                for feature, cut, value in zip(*(a[chunk.set] for a in trees))
            ]
        )
    return score


def _rounded(values: np.ndarray) -> np.ndarray:
    return np.round(values * (1 << STEP_BITS)) / (1 << STEP_BITS)


def node_histograms(
    chunks: Iterator[Chunk], loss: Loss, recent: list[Trees], grown: Trees, level: int, number: int, growth: Growth
) -> np.ndarray | None:
    """Sums of gradient, curvature and rows by (set, output, node, feature, bin) over some chunks.

    Below the root only the left child of each pair is added up; the right one is its parent's rest.
    """
    n_sets, outputs = grown.feature.shape[:2]
    nodes = max(1, 1 << level >> 1)
    out = None
    for chunk in chunks:
        if out is None:
            out = np.zeros((n_sets, outputs, nodes, len(chunk.x), growth.bins, 3))
        score = current_score(chunk, recent, growth.step)
        gradient, curvature, drawn = loss.gradients(chunk, score, number)
        gradient, curvature = _rounded(gradient), _rounded(curvature)
        for k in range(outputs):
            node = walk(chunk.x, grown.feature[chunk.set, k], grown.cut[chunk.set, k], level)
            wanted = node % 2 == 0 if drawn is None else drawn & (node % 2 == 0)
            at = np.flatnonzero(wanted)
            base, g, h = (node[at] >> 1 if level else node[at]) * growth.bins, gradient[k, at], curvature[k, at]
            for f, bins in enumerate(chunk.x):
                key = base + bins[at]
                for j, weights in enumerate((g, h, None)):
                    out[chunk.set, k, :, f, :, j] += np.bincount(key, weights, nodes * growth.bins).reshape(nodes, -1)
    return out


def leaf_counts(
    chunks: Iterator[Chunk], loss: Quantiles, recent: list[Trees], grown: Trees, number: int, growth: Growth
) -> np.ndarray | None:
    """Rows by (set, output, leaf, place of the residual) over some chunks; drawn rows only."""
    n_sets, outputs, leaves = grown.value.shape
    out = None
    for chunk in chunks:
        if out is None:
            out = np.zeros((n_sets, outputs, leaves, loss.places), np.int64)
        residual = loss.place(chunk.y - current_score(chunk, recent, growth.step))
        drawn = loss.drawn(chunk.draw, number)
        for k in range(outputs):
            leaf = walk(chunk.x, grown.feature[chunk.set, k], grown.cut[chunk.set, k], growth.depth)
            key = leaf[drawn] * loss.places + residual[k, drawn]
            out[chunk.set, k] += np.bincount(key, minlength=leaves * loss.places).reshape(leaves, -1)
    return out


def _summed(chunks: RDD, add_up: Callable[[Iterator[Chunk]], np.ndarray | None]) -> RDD:
    """The tasks' arrays added up, by place along their first axis: each place's arrays meet in one task. All have one size."""

    def run(part: Iterator[Chunk]) -> Iterator[tuple[int, np.ndarray]]:
        found = add_up(part)
        return iter([]) if found is None else enumerate(found)

    return chunks.mapPartitions(run).reduceByKey(np.add, min(chunks.getNumPartitions(), chunks.ctx.defaultParallelism))


def _added(
    chunks: RDD, add_up: Callable[[Iterator[Chunk]], np.ndarray | None], pick: Callable[[int, np.ndarray], np.ndarray] | None = None
) -> np.ndarray:
    """The tasks' arrays added up, or what ``pick`` takes from the sum of each place along the first axis."""
    return _picked(_summed(chunks, add_up), pick or (lambda place, total: total))


def _picked(sums: RDD, pick: Callable[[int, np.ndarray], object]) -> np.ndarray:
    found = sums.map(lambda item: (item[0], pick(*item))).collect()
    return np.stack([value for _, value in sorted(found, key=lambda item: item[0])])


def best_splits(sums: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per (set, output, node): feature, last bin that goes left (``NO_SPLIT`` if nothing gains) and the sums to its left.

    The gain is that of a Newton step on either side; equal gains go to the first feature and bin.
    """
    left = sums.cumsum(axis=-2)
    total = left[..., :1, -1:, :]
    right = total - left

    def gain(part: np.ndarray) -> np.ndarray:
        return np.divide(part[..., 0] ** 2, part[..., 1], out=np.zeros(part.shape[:-1]), where=part[..., 1] > 1e-3)

    fits = (left[..., 2] >= min_leaf) & (right[..., 2] >= min_leaf) & (left[..., 1] > 1e-3) & (right[..., 1] > 1e-3)
    gains = np.where(fits, gain(left) + gain(right) - gain(total), 0.0)
    flat = gains.reshape(*gains.shape[:3], -1)
    best = flat.argmax(axis=-1)
    feature, cut = np.divmod(best, sums.shape[-2])
    gained = np.take_along_axis(flat, best[..., None], -1)[..., 0] > 1e-12
    at = tuple(np.indices(best.shape))
    left_sums = np.where(gained[..., None], left[(*at, feature, cut)], total[..., 0, 0, :])
    return np.where(gained, feature, 0), np.where(gained, cut, NO_SPLIT), left_sums


def grow_round(chunks: RDD, loss: Loss, recent: list[Trees], number: int, growth: Growth, shape: tuple[int, int]) -> Trees:
    """One tree per set and output."""
    splits = (1 << growth.depth) - 1
    trees = Trees(np.zeros((*shape, splits), np.int64), np.full((*shape, splits), NO_SPLIT), np.zeros((*shape, splits + 1)))
    places, sums, rows = shape[0] * shape[1], None, np.zeros(0)

    def whole(pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Histograms of all nodes of a level from those of the left children and of the level above."""
        found, above = pair
        return np.stack([found, above - found], axis=1).reshape(-1, *found.shape[1:])

    def pick(place: int, total: np.ndarray) -> np.ndarray:
        """Feature, cut, sums to the left and sums of each node."""
        feature, cut, left = best_splits(total[None, None], growth.min_leaf)
        return np.column_stack([feature[0, 0], cut[0, 0], left[0, 0], total[:, 0].sum(axis=-2)])

    for level in range(growth.depth):

        def add_up(part: Iterator[Chunk], level: int = level) -> np.ndarray | None:
            found = node_histograms(part, loss, recent, trees, level, number, growth)
            return None if found is None else found.reshape(places, *found.shape[2:])

        above, sums = sums, _summed(chunks, add_up)
        sums = sums if above is None else sums.join(above, sums.getNumPartitions()).mapValues(whole)
        sums.persist(StorageLevel.MEMORY_AND_DISK)
        rows = _picked(sums, pick).reshape(*shape, 1 << level, -1)
        if above is not None:
            above.unpersist()
        here = slice((1 << level) - 1, (2 << level) - 1)
        trees.feature[..., here], trees.cut[..., here] = rows[..., 0], rows[..., 1]
    sums.unpersist()
    if isinstance(loss, Quantiles):

        def count(part: Iterator[Chunk]) -> np.ndarray | None:
            found = leaf_counts(part, loss, recent, trees, number, growth)
            return None if found is None else found.reshape(places, *found.shape[2:])

        def value(place: int, counts: np.ndarray) -> np.ndarray:
            own = place % loss.outputs
            return loss.leaf_values(counts[None, None], slice(own, own + 1))[0, 0]

        trees.value[...] = _added(chunks, count, value).reshape(*shape, splits + 1)
    else:
        left, total = rows[..., 2:5], rows[..., 5:]
        ends = np.stack([left, total - left], axis=3).reshape(*shape, splits + 1, 3)
        trees.value[...] = np.divide(-ends[..., 0], ends[..., 1], out=np.zeros(ends.shape[:-1]), where=ends[..., 1] > 1e-3)
    return trees


def fit_forest(rows: DataFrame, n_sets: int, loss: Loss, growth: Growth) -> Forest:
    """Fit all sets of ``rows``: the features, ``y``, ``draw`` (a number from the row's key) and ``w``, an array with the row's
    weight in each set, 0 where it is left out. Sets without rows stay unfitted. ``rows`` should be a stored table."""
    shape = (n_sets, loss.outputs)
    bases = loss.bases(rows, n_sets) if n_sets else np.zeros(shape)
    fitted = np.isfinite(bases).any(axis=1)
    cuts = feature_cuts(rows, n_sets, growth.bins) if fitted.any() else np.zeros((n_sets, len(FEATURES), growth.bins - 1))
    grown: list[Trees] = []
    if fitted.any():
        shared_dir(rows.sparkSession)  # scores are checkpointed there
        chunks = packed(rows).rdd.flatMap(_split_sets(cuts, bases)).persist(StorageLevel.MEMORY_AND_DISK)
        recent: list[Trees] = []
        for number in range(growth.rounds):
            grown.append(grow_round(chunks, loss, recent, number, growth, shape))
            recent.append(grown[-1])
            if len(recent) == growth.store_every and number + 1 < growth.rounds:
                chunks, recent = _stored(chunks, recent, growth.step), []
        chunks.unpersist()
    splits = (1 << growth.depth) - 1
    feature, cut = (np.stack([t[j] for t in grown], axis=2) if grown else np.zeros((*shape, 0, splits), int) for j in (0, 1))
    value = np.stack([t.value for t in grown], axis=2) if grown else np.zeros((*shape, 0, splits + 1))
    wide = np.concatenate([cuts, np.full((*cuts.shape[:2], 1), np.inf)], axis=2)
    sets = np.arange(n_sets)[:, None, None, None]
    threshold = wide[sets, feature, np.minimum(cut, wide.shape[2] - 1)]
    return Forest(bases, growth.step, feature, threshold, value, fitted)


def _stored(chunks: RDD, recent: list[Trees], step: float) -> RDD:
    """The chunks with scores brought up to date, cut off from what came before."""

    def update(chunk: Chunk) -> Chunk:
        return chunk._replace(score=current_score(chunk, recent, step))

    fresh = chunks.map(update).persist(StorageLevel.MEMORY_AND_DISK)
    fresh.checkpoint()
    fresh.count()
    chunks.unpersist()
    return fresh
