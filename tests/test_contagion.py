import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation

from tickerloom.operators import contagion as C

START = dt.date(2020, 1, 1)


def returns_table(spark, matrix, names, drop=()):
    rows = [
        (names[j], START + dt.timedelta(days=i), float(matrix[i, j]))
        for i in range(matrix.shape[0])
        for j in range(matrix.shape[1])
        if (i, j) not in drop
    ]
    return spark.createDataFrame(rows, "symbol string, date date, daily_return double")


@pytest.mark.parametrize("block", [2, 3, 100])
def test_blocked_product_equals_numpy(spark, block):
    x = np.random.default_rng(0).normal(size=(31, 9))
    x[:, 4] = 0.3
    names = [f"S{k}" for k in range(9)]
    drop = {(3, 1), (4, 1), (30, 2)}
    table = returns_table(spark, x, names, drop)
    got = {(r.symbol_a, r.symbol_b): r for r in C.pair_correlations(C.return_vectors(table), block_symbols=block).collect()}
    filled = x.copy()
    for i, j in drop:
        filled[i, j] = 0.0
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(filled.T)
    assert len(got) == 45
    for a in range(9):
        for b in range(a, 9):
            r = got[(names[a], names[b])]
            if 4 in (a, b):
                assert r.corr is None
            else:
                assert r.corr == pytest.approx(want[a, b], abs=1e-12)
            assert r.n_days == 31
    assert got[("S1", "S2")].n_common == 28


def test_agrees_with_the_dense_routine(spark):
    x = np.random.default_rng(3).normal(size=(31, 5))
    names = [f"S{k}" for k in range(5)]
    table = returns_table(spark, x, names)
    wide = C.pivot_returns(table, names)
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(wide)
    dense = Correlation.corr(vectors, "v").first()[0].toArray()
    square = C.wide_matrix(C.pair_correlations(C.return_vectors(table)), names).orderBy("symbol_a").drop("symbol_a")
    np.testing.assert_allclose(np.array(square.collect(), dtype=float), dense, atol=1e-10)


def test_blocks_that_cannot_reach_the_threshold_do_not_meet(spark):
    rng = np.random.default_rng(11)
    bases = rng.normal(size=(31, 6))
    x = np.column_stack([bases[:, [k % 6]] * (1 if k % 7 else -1) + 0.2 * rng.normal(size=(31, 1)) for k in range(150)])
    x[:, 17] = 0.5
    names = [f"S{k:03d}" for k in range(150)]
    vectors = C.stage(C.return_vectors(returns_table(spark, x, names, {(3, 1), (9, 40)})), "vectors")
    every = {(r.symbol_a, r.symbol_b): r.corr for r in C.pair_correlations(vectors, block_symbols=10).collect()}
    for least in (0.7, -0.2):
        got = {(r.symbol_a, r.symbol_b): r.corr for r in C.pair_correlations(vectors, least, block_symbols=10).collect()}
        want = {k: v for k, v in every.items() if v is not None and v >= least}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    met = C.blocks_in_reach(vectors, 0.7, 10)
    blocks, pairs = met.select("block").distinct().count(), met.select("bi", "bj").distinct().count()
    assert blocks > 12 and pairs < blocks * (blocks + 1) / 2 / 3
    assert C.pair_correlations(vectors.filter("symbol = 'S017'").unionByName(vectors.filter("symbol = 'S017'")), 0.7, 1).count() == 0


def brute_components(edges):
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {a: root(a) for a in parent}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 60, size=(35, 2)) if a < b}
    edges |= {(f"p{k:03d}", f"p{k + 1:03d}") for k in range(25)}  # a long path
    edges |= {("hub", f"h{k:02d}") if "hub" < f"h{k:02d}" else (f"h{k:02d}", "hub") for k in range(40)}
    df = spark.createDataFrame(sorted(edges), "symbol_a string, symbol_b string")
    got = {r.symbol: r.cluster for r in C.connected_components(df).collect()}
    assert got == brute_components(edges)


def test_clusters_cover_every_symbol(spark):
    base = np.random.default_rng(5).normal(size=31)
    other = np.random.default_rng(6).normal(size=31)
    noise = np.random.default_rng(7).normal(size=(31, 5)) * 0.05
    x = np.column_stack([base, base, other, other, np.zeros(31)]) + noise * [1, 1, 1, 1, 0]
    got = {r.symbol: r.cluster for r in C.contagion_clusters(returns_table(spark, x, list("ABCDE")), 0.9).collect()}
    assert got == {"A": "A", "B": "A", "C": "C", "D": "C", "E": "E"}


def test_submatrix_keeps_the_dates_of_the_whole_window(spark):
    x = np.random.default_rng(8).normal(size=(31, 3))
    table = returns_table(spark, x, list("ABC"), {(k, 0) for k in range(5)})
    chosen = spark.createDataFrame([("A",)], "symbol string")
    got = C.submatrix(table, chosen).collect()
    assert len(got) == 1 and got[0].n_days == 31 and got[0].n_common == 26
