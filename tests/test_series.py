import math

import numpy as np
import pandas as pd
import pytest
from conftest import START, by_key

from tickerloom.operators import features as X
from tickerloom.operators import labels as L
from tickerloom.operators import selection as S
from tickerloom.operators.ranking import describe, describe_approx, leaderboard, top_safest
from tickerloom.operators.returns import scored_series
from tickerloom.ordering import running_totals


def prices_of(n, seed=0):
    rng = np.random.default_rng(seed)
    return (10 * np.exp(np.cumsum(rng.normal(0, 0.05, n)))).tolist()


def brute_features(p, v, btc):
    """Row-by-row definition of the sixteen inputs for rows with a full history."""
    p, v, btc = map(np.asarray, (p, v, btc))
    r = np.zeros(len(p))
    r[1:] = np.clip(np.diff(p) / (np.abs(p[:-1]) + 1e-9), -0.5, 5)
    macd = pd.Series(r).ewm(span=12, adjust=False).mean() - pd.Series(r).ewm(span=26, adjust=False).mean()
    out = {}
    for i in range(30, len(p)):
        w7, w14, q = r[i - 6 : i + 1], r[i - 13 : i + 1], p[i - 19 : i + 1]
        up, down = w14[w14 > 0], -w14[w14 < 0]
        gain, loss = (up.mean() if len(up) else 0.0), (down.mean() if len(down) else 1e-9)
        out[i] = [
            r[i], r[i - 1], r[i - 2], r[i - 4], r[i - 6], r[i - 13], w7.mean(), w14.mean(),
            w7.std() + 1e-9, w14.std() + 1e-9, macd[i], 100 - 100 / (1 + gain / loss),
            (p[i] - p[i - 30]) / (p[i - 30] + 1e-9), v[i] / (v[i - 6 : i + 1].mean() + 1e-9),
            (p[i] - q.mean()) / (2 * (q.std() + 1e-9)), btc[i - 1],
        ]
    return r, out


@pytest.mark.parametrize("n", [1, 2, 30, 31, 32, 180, 400])
def test_features_match_their_definition(spark, usd_series, n):
    p, rng = prices_of(n, n), np.random.default_rng(n)
    v, btc = rng.uniform(1, 9, n).tolist(), rng.normal(0, 0.1, n).tolist()
    frame = X.feature_frame(usd_series({"A": p}, volume=v, btc=btc))
    rows = {r.i: r for r in frame.collect()}
    r, want = brute_features(p, v, btc)
    assert len(rows) == n
    np.testing.assert_allclose([rows[i].r for i in range(n)], r, atol=1e-12)
    for i, values in want.items():
        np.testing.assert_allclose([rows[i][c] for c in X.FEATURES], values, rtol=1e-8, atol=1e-10)
    assert X.feature_rows(frame).count() == max(0, n - 31)


@pytest.mark.parametrize("values", [[5.0] * 60, [float(k + 1) for k in range(60)], [float(90 - k) for k in range(60)], [0.0] + [3.0] * 59])
def test_features_of_flat_rising_falling_and_zero_start(spark, usd_series, values):
    _, want = brute_features(values, [1.0] * 60, [0.0] * 60)
    rows = {r.i: r for r in X.feature_frame(usd_series({"A": values})).collect()}
    for i in (30, 45, 59):
        np.testing.assert_allclose(rows[i].rsi, want[i][11], atol=1e-6)
        np.testing.assert_allclose(rows[i].macd, want[i][10], atol=1e-12)


def test_moving_average_over_many_blocks(spark, usd_series):
    rng = np.random.default_rng(1)
    values = np.abs(rng.standard_t(2, 1500)) + 0.1
    frame = X.with_emas(X.with_model_return(usd_series({"A": values.tolist(), "B": values[:129].tolist()})))
    pdf = frame.toPandas().sort_values(["symbol", "i"])
    for symbol in ("A", "B"):
        got = pdf[pdf.symbol == symbol]
        for span in (12, 26):
            want = got.r.ewm(span=span, adjust=False).mean()
            assert np.abs(got[f"ema{span}"] - want).max() < 1e-12


def test_frame_uses_one_shuffle_by_symbol(spark, usd_series):
    plan = L.labelled_panel(X.feature_frame(usd_series({"A": prices_of(50)})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_later_prices_do_not_change_earlier_features(spark, usd_series):
    p = prices_of(80)
    changed = p[:60] + [x * 3 for x in p[60:]]
    keep = ["symbol", "date", *X.FEATURES]
    a = {r.date: r for r in X.feature_frame(usd_series({"A": p})).filter("i < 60").select(*keep).collect()}
    b = {r.date: r for r in X.feature_frame(usd_series({"A": changed})).filter("i < 60").select(*keep).collect()}
    assert a == b


def test_row_order_and_layout_do_not_matter(spark, usd_series):
    df = usd_series({"A": prices_of(70, 1), "B": prices_of(70, 2)})
    a = sorted(scored_series(df).collect())
    b = sorted(scored_series(df.orderBy("close_usd").repartition(5)).collect())
    assert a == b


def test_scores_of_constant_zero_and_short_series(spark, usd_series):
    df = scored_series(usd_series({"FLAT": [2.0] * 40, "ONE": [1.0], "ZERO": [0.0, 4.0, 5.0]}))
    rows = by_key(df, "symbol", "date")
    assert all(r.safety_score == 0 and r.volatility_7d == 0 for (s, _), r in rows.items() if s in ("FLAT", "ONE"))
    zero = [r for (s, _), r in sorted(rows.items()) if s == "ZERO"]
    assert [r.daily_return for r in zero] == [0.0, 0.0, 0.25]
    assert zero[2].volatility_7d == pytest.approx(np.std([0, 0, 0.25], ddof=1) * math.sqrt(365))


def test_rows_not_days_make_up_the_frames(spark, usd_series):
    p = prices_of(31)
    gap = usd_series({"A": p}, days=[*range(30), 200])
    last = [r for r in scored_series(gap).collect() if r.close_usd_30d_ago is not None]
    assert len(last) == 1 and last[0].return_30d == pytest.approx(p[30] / p[0] - 1)


def test_trailing_window_has_31_dates(spark, usd_series):
    df = usd_series({"A": prices_of(100), "B": prices_of(50)})
    assert S.trailing_days(df).count() == 31
    assert {r.symbol for r in S.at_latest_date(df).collect()} == {"A"}
    assert {r.symbol: r.n_days for r in S.coverage(df, 0.9).collect()} == {"A": 100}
    assert [tuple(r) for r in S.distinct_counts(df).collect()] == [(2, 100)]
    assert S.distinct_counts(df, approximate=True).first().n_symbols == 2


def test_quality_gate(spark, usd_series):
    df = usd_series({"LONG": prices_of(180, 3), "SHORT": prices_of(179, 3), "STABLE": [1.0] * 200})
    assert {r.symbol for r in S.series_quality_gate(df, min_variation=0.05).collect()} == {"LONG"}
    assert {r.symbol for r in S.series_quality_gate(df, min_variation=None).collect()} == {"LONG", "STABLE"}


def test_thresholds_fall_back_without_movement(spark, usd_series):
    frame = X.with_model_return(usd_series({"FLAT": [1.0] * 40, "A": prices_of(40)}))
    got = by_key(L.exact_percentiles(frame), "symbol")
    assert (got[("FLAT",)].p30, got[("FLAT",)].p70) == (-0.01, 0.01)
    r = np.array([x.r for x in frame.filter("symbol = 'A'").collect()])
    assert got[("A",)].p30 == pytest.approx(np.percentile(r[r != 0], 30))


def panel(usd_series, n=300):
    return L.labelled_panel(X.feature_frame(usd_series({"A": prices_of(n, 5), "B": prices_of(n - 40, 6)})), min_variation=0.0)


def test_folds_and_split(spark, usd_series):
    rows = L.walk_forward_folds(L.chrono_split(panel(usd_series)).drop("part"))
    for symbol, n in (("A", 269), ("B", 229)):
        size = n // 4
        for fold in range(3):
            got = rows.filter(f"symbol = '{symbol}' AND fold = {fold}").select("k", "part").collect()
            test = sorted(r.k for r in got if r.part == "test")
            train = sorted(r.k for r in got if r.part == "train")
            start = n - (3 - fold) * size
            assert test == list(range(start, start + size)) and train == list(range(start))
    cut = L.chrono_split(panel(usd_series)).filter("symbol = 'A' AND part = 'train'").count()
    assert cut == int(269 * 0.8)


def test_label_options(spark, usd_series):
    frame = X.feature_frame(usd_series({"A": prices_of(300, 5)}))
    plain = L.labelled_panel(frame, min_variation=0.0)
    more = L.labelled_panel(frame, min_variation=0.0, include_next=True)
    assert more.count() == plain.count() + 1
    assert [(r.label, (r.next_date - START).days) for r in more.filter("label is null").collect()] == [(None, 300)]
    assert L.labelled_panel(frame, min_variation=0.0, fit_on="train").select("p30").first() != plain.select("p30").first()


def test_balanced_weights_sum_to_rows(spark, usd_series):
    rows = L.with_balanced_weights(panel(usd_series))
    assert rows.groupBy("symbol").sum("weight").collect()[0][1] == pytest.approx(rows.filter("symbol='A'").count(), rel=0.2)
    joined = rows.join(L.balanced_weights(panel(usd_series)).withColumnRenamed("weight", "w2"), ["symbol", "label"])
    assert joined.filter("abs(weight - w2) > 1e-12").count() == 0


def test_rankings(spark, usd_series):
    df = scored_series(usd_series({f"S{k:02d}": prices_of(40, k) for k in range(15)}))
    top = top_safest(df).collect()
    best = sorted((r for r in df.filter(f"date = '{START.replace(month=2, day=9)}'").collect()), key=lambda r: (-r.safety_score, r.symbol))
    assert [r.symbol for r in top] == [r.symbol for r in best[:10]]
    assert [leaderboard(df, "return_30d", n).count() for n in (3, 300, 400)] == [3, 15, 15]
    with pytest.raises(ValueError):
        leaderboard(df, "return_30d", 0)


def test_describe_is_exact(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(size=30_001), 2)
    table = spark.createDataFrame([(float(v), None, 7.0 if k else None) for k, v in enumerate(values)], "x double, y double, z double")
    got = {r.measure: r for r in describe(table, ["x", "y", "z"]).collect()}
    ranked = np.sort(values)
    assert [got["x"][c] for c in ("q25", "q50", "q75")] == [ranked[math.ceil(30_001 * s) - 1] for s in (0.25, 0.5, 0.75)]
    assert got["x"].n == 30_001 and got["x"].mean == pytest.approx(values.mean())
    assert got["y"].n == 0 and got["y"].q50 is None and (got["z"].n, got["z"].q25) == (30_000, 7.0)
    near = describe_approx(table, ["x"]).first()
    assert abs(near.q50 - got["x"].q50) < 0.02


def test_running_totals_of_one_range_sort(spark):
    rows = [(k, (7 * k) % 50, float(k % 3), None if k % 11 == 0 else k) for k in range(200)] + [(200, None, 1.0, 5)]
    df = spark.createDataFrame(rows, "id long, at long, x double, y long")
    got = running_totals(df, ["at", "id"], {"sum_x": "x", "sum_y": "y"}).collect()
    x, y, want = 0.0, 0, {}
    for row in sorted(rows, key=lambda r: (r[1] is None, r[1], r[0])):
        x, y = x + row[2], y + (row[3] or 0)
        want[row[0]] = (x, y)
    assert {r.id: (r.sum_x, r.sum_y) for r in got} == want
    assert running_totals(df.limit(0), ["at"], {"sum_x": "x"}).count() == 0
