"""Cross-asset correlation of daily returns over a trailing window, and the clusters it forms.

The correlation table is the product of a (symbols x days) matrix with its transpose. It is computed as a blocked
matrix product: symbols are hashed into blocks of bounded size, every pair of blocks meets in one task, keyed by the
pair's id, and numpy multiplies the two small matrices there. No pair-by-day rows are produced and
nothing is gathered on the driver, unlike a correlation routine that returns one dense local matrix.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.selection import trailing_days
from tickerloom.workspace import stage

BLOCK_SYMBOLS = 512
PIVOTS = 64
PIVOT_SAMPLE = 1024
SHELL = 0.2  # radians

# The block product's functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS = "symbol_a string, symbol_b string, corr double, n_days bigint, n_common bigint"


def return_vectors(scored: DataFrame, days: int = 30) -> DataFrame:
    """One row per symbol: its returns on every date of the window, NaN where it has no bar.

    The list of dates is at most ``days + 1`` long and travels as a scalar subquery; a symbol has one row per date,
    so what is gathered per symbol is bounded by the same number.
    """
    recent = trailing_days(scored.select("symbol", "date", "daily_return"), days)
    dates = recent.agg(F.array_sort(F.collect_set("date"))).scalar()
    by_date = F.map_from_entries(F.collect_list(F.struct("date", "daily_return")))
    absent = F.lit(float("nan"))
    return (
        recent.groupBy("symbol")
        .agg(by_date.alias("_m"))
        .withColumn("_d", dates)
        .select(
            "symbol", F.transform("_d", lambda d: F.coalesce(F.try_element_at("_m", d), absent)).alias("vec")
        )
    )


def _matrix(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Returns with 0 on days without a bar, and 1/0 for days with and without one."""
    raw = np.vstack(rows.to_list()).astype(float)
    return np.nan_to_num(raw), (~np.isnan(raw)).astype(float)


def _unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred rows of length one, and which rows vary at all."""
    varies = x.max(axis=1) > x.min(axis=1)
    centred = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((centred * centred).sum(axis=1, keepdims=True))
    return centred / np.where(norm > 0, norm, 1.0), varies & (norm[:, 0] > 0)


def _multiply(min_corr: float | None):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["block"] == key[0]]
        right = rows[rows["block"] == key[1]]
        if left.empty or right.empty:
            return pd.DataFrame({"symbol_a": [], "symbol_b": [], "corr": [], "n_days": [], "n_common": []})
        names_a, names_b = left["symbol"].to_numpy(str), right["symbol"].to_numpy(str)
        (x_a, seen_a), (x_b, seen_b) = _matrix(left["vec"]), _matrix(right["vec"])
        (unit_a, ok_a), (unit_b, ok_b) = _unit_rows(x_a), _unit_rows(x_b)
        corr = np.clip(unit_a @ unit_b.T, -1.0, 1.0)
        defined = ok_a[:, None] & ok_b[None, :]
        keep = np.ones_like(defined) if min_corr is None else defined & (corr >= min_corr)
        if key[0] == key[1]:
            keep &= names_a[:, None] <= names_b[None, :]
        i, j = np.nonzero(keep)
        common = seen_a @ seen_b.T
        a, b = names_a[i], names_b[j]
        swap = a > b
        return pd.DataFrame(
            {
                "symbol_a": np.where(swap, b, a),
                "symbol_b": np.where(swap, a, b),
                "corr": pd.Series(corr[i, j], dtype="Float64").mask(~defined[i, j]),
                "n_days": np.full(len(i), unit_a.shape[1], dtype="int64"),
                "n_common": common[i, j].round().astype("int64"),
            }
        )

    return run


def _pivots(vectors: DataFrame) -> np.ndarray:
    """Directions far from each other among a bounded sample of the vectors, one row each."""
    sample = vectors.orderBy(F.xxhash64("symbol"), "symbol").limit(PIVOT_SAMPLE).select("vec").toPandas()
    if sample.empty:
        return np.zeros((0, 0))
    unit, varies = _unit_rows(_matrix(sample["vec"])[0])
    unit = unit[varies]
    chosen, nearest = [0] if len(unit) else [], np.full(len(unit), -2.0)
    while 0 < len(chosen) < min(PIVOTS, len(unit)):
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
        chosen.append(int(nearest.argmin()))
    return unit[chosen]


def _cells_in_reach(cells: pd.DataFrame, pivots: np.ndarray, min_corr: float) -> np.ndarray:
    """Which pairs of cells can hold two vectors of that correlation. Vectors of a cell lie between two angles from its pivot,
    and angles between directions obey the triangle inequality."""
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    apart = between[np.ix_(cells["pivot"], cells["pivot"])]
    low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
    least = np.maximum(apart - high[:, None] - high[None, :], low[:, None] - apart - high[None, :])
    least = np.maximum(least, low[None, :] - apart - high[:, None])
    return least <= math.acos(min(max(min_corr, -1.0), 1.0)) + 1e-6


def blocks_in_reach(vectors: DataFrame, min_corr: float, block_symbols: int = BLOCK_SYMBOLS) -> DataFrame:
    """``symbol, vec, block, bi, bj``: each vector that varies, once per pair of blocks whose members can have a correlation of
    ``min_corr``.

    A block is a part of a cell: the vectors nearest to one of ``PIVOTS`` directions, in shells by their angle to it. The
    driver sees the bounds of the cells, whose number does not depend on that of the symbols.
    """
    pivots = _pivots(vectors)

    def place(frames):
        for rows in frames:
            if len(rows) and len(pivots):
                unit, varies = _unit_rows(_matrix(rows["vec"])[0])
                dots = unit @ pivots.T
                angle = np.arccos(np.clip(dots.max(axis=1), -1.0, 1.0))
                found = rows.assign(pivot=dots.argmax(axis=1), shell=(angle / SHELL).astype(int), angle=angle)
                yield found[varies]

    kind = vectors.schema["symbol"].dataType.simpleString()
    columns = f"symbol {kind}, vec array<double>, pivot int, shell int, angle double"
    placed = stage(vectors.select("symbol", "vec").mapInPandas(place, columns), "placed")
    bounds = placed.groupBy("pivot", "shell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    cells = bounds.toPandas().sort_values(["pivot", "shell"], ignore_index=True)
    parts = -(-cells["n"].to_numpy() // block_symbols)
    first = np.cumsum(parts) - parts
    ranges = []
    for k, reach in enumerate(_cells_in_reach(cells, pivots, min_corr) if len(cells) else []):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], reach.astype(int), [0]))))  # cells side by side are one range
        met = [(int(first[x]), int(first[y - 1] + parts[y - 1] - 1)) for x, y in zip(edges[::2], edges[1::2])]
        ranges.append((int(cells["pivot"][k]), int(cells["shell"][k]), int(first[k]), int(parts[k]), met))
    table = placed.sparkSession.createDataFrame(
        ranges, "pivot int, shell int, first int, parts int, met array<struct<low:int,high:int>>"
    )
    tagged = placed.join(F.broadcast(table), ["pivot", "shell"])  # a row per cell
    block = (F.col("first") + F.pmod(F.xxhash64("symbol"), F.col("parts"))).cast("int")
    partners = F.flatten(F.transform("met", lambda r: F.sequence(r["low"], r["high"])))
    met = tagged.select("symbol", "vec", block.alias("block"), F.explode(partners).alias("_other"))
    return met.select("symbol", "vec", "block", F.least("block", "_other").alias("bi"), F.greatest("block", "_other").alias("bj"))


def pair_correlations(
    vectors: DataFrame, min_corr: float | None = None, block_symbols: int = BLOCK_SYMBOLS
) -> DataFrame:
    """Pearson correlation of every unordered pair ``symbol_a <= symbol_b``; null where a series never varies.

    ``vectors`` should be a stored table. With ``min_corr`` pairs of blocks that cannot reach it do not meet, and the comparison
    happens inside the block product, so weaker pairs are never materialised. A task holds two blocks, about
    ``2 * block_symbols`` short vectors, whatever the number of symbols is.
    """
    blocks = max(1, math.ceil(vectors.count() / block_symbols))
    if min_corr is not None and blocks > 1:
        met = blocks_in_reach(vectors, min_corr, block_symbols)
        return met.groupBy("bi", "bj").applyInPandas(_multiply(min_corr), PAIRS)
    tagged = vectors.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = tagged.withColumn("_other", partner).withColumns(
        {"bi": F.least("block", "_other"), "bj": F.greatest("block", "_other")}
    )
    return met.drop("_other").groupBy("bi", "bj").applyInPandas(_multiply(min_corr), PAIRS)


def contagion_matrix(scored: DataFrame, days: int = 30) -> DataFrame:
    return pair_correlations(stage(return_vectors(scored, days), "return_vectors"))


def submatrix(scored: DataFrame, symbols: DataFrame, days: int = 30) -> DataFrame:
    """The matrix restricted to a set of symbols on both axes; the restriction precedes the product."""
    chosen = return_vectors(scored, days).join(symbols, "symbol", "left_semi")
    return pair_correlations(stage(chosen, "return_vectors"))


def both_orders(pairs: DataFrame) -> DataFrame:
    """Full square form: every off-diagonal pair once in each order."""
    rest = [c for c in pairs.columns if c not in ("symbol_a", "symbol_b")]
    mirrored = pairs.filter("symbol_a <> symbol_b").select(
        F.col("symbol_b").alias("symbol_a"), F.col("symbol_a").alias("symbol_b"), *rest
    )
    return pairs.unionByName(mirrored)


def wide_matrix(pairs: DataFrame, symbols: list[str]) -> DataFrame:
    """Labelled wide matrix for a given list of symbols, for export."""
    square = both_orders(pairs).filter(F.col("symbol_a").isin(symbols) & F.col("symbol_b").isin(symbols))
    return square.groupBy("symbol_a").pivot("symbol_b", symbols).agg(F.first("corr"))


def pivot_returns(scored: DataFrame, symbols: list[str]) -> DataFrame:
    """Dates by symbols, 0 where a symbol has no bar; naming the symbols saves the job that would look them up."""
    return scored.groupBy("date").pivot("symbol", symbols).agg(F.avg("daily_return")).na.fill(0.0)


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _both_directions(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    near = _both_directions(edges)
    linked = near.join(_smallest_neighbour(near), "u").filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = down.join(_smallest_neighbour(down), "u")
    smallest = F.col("m").alias("v")
    both = F.array(F.struct(F.col("v").alias("u"), smallest), F.struct("u", smallest))
    return linked.select(F.inline(both)).filter("u <> v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node points at a root, that is no node that is pointed at points further, and none at two roots."""
    start = F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    end = F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    degrees = edges.select(F.inline(F.array(start, end))).groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    return degrees.filter("out > 1 or (out > 0 and in > 0)").isEmpty()


def star_forest(edges: DataFrame) -> DataFrame:
    """``u, v``: each node of the stored ``edges`` (``u, v``) with the smallest node of its component, which itself has no row.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and
    Beyond" (2014). The number of edges never grows, the groups are reduced by aggregation and never collected, and
    each round's edges are written to the shared folder, so neither hubs nor lost executors hurt.
    """
    while True:  # each round links nodes to smaller ones, so this ends
        edges = stage(_small_star(_large_star(edges)), "edges")
        if _is_star_forest(edges):
            return edges


def connected_components(edges: DataFrame) -> DataFrame:
    """Component label (smallest member) of every node that has an edge, see :func:`star_forest`."""
    current = star_forest(stage(edges.select(F.col("symbol_a").alias("u"), F.col("symbol_b").alias("v")).distinct(), "edges"))
    members = current.select(F.col("u").alias("symbol"), F.col("v").alias("cluster"))
    roots = current.select(F.col("v").alias("symbol"), F.col("v").alias("cluster")).distinct()
    return members.unionByName(roots)


def contagion_clusters(scored: DataFrame, threshold: float = 0.7, days: int = 30) -> DataFrame:
    """Every symbol of the window with its cluster; symbols without a strong partner form their own."""
    vectors = stage(return_vectors(scored, days), "return_vectors")
    strong = pair_correlations(vectors, threshold).filter("symbol_a <> symbol_b")
    grouped = connected_components(strong)
    return vectors.select("symbol").join(grouped, "symbol", "left").select(
        "symbol", F.coalesce("cluster", "symbol").alias("cluster")
    )
