import datetime as dt
import pickle

import duckdb
import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F
from test_series import prices_of

import catalog
from catalog import frames as N
from catalog import models as M
from tickerloom.learning import boosting as B
from tickerloom.learning import classifier as K
from tickerloom.learning import forecast as C
from tickerloom.learning import quantile as Q
from tickerloom.learning.classifier import ClassifierSettings, generate_signals, train_classifier, training_rows
from tickerloom.learning.store import fingerprint, load_forest, reusing, save_forest
from tickerloom.learning.walkforward import walk_forward_eval
from tickerloom.operators import features as X
from tickerloom.operators import labels as L
from tickerloom.operators import signals as G
from tickerloom.workspace import fresh_path, stage

FEW = ClassifierSettings(rounds=2)
FEW_Q = Q.QuantileSettings(rounds=3)


@pytest.fixture(scope="module")
def frame(usd_series):
    return stage(X.feature_frame(usd_series({"A": prices_of(260, 1), "B": prices_of(220, 2), "SHORT": prices_of(179, 3)})), "frame")


@pytest.fixture(scope="module")
def panel(frame):
    return stage(L.labelled_panel(frame, min_variation=0.0), "panel")


@pytest.fixture(scope="module")
def quantile_models(panel):
    return Q.boost_quantiles(panel, C.QUANTILES, settings=FEW_Q)


def test_signals(panel):
    signals = generate_signals(panel, FEW)
    rows = signals.collect()
    split = L.chrono_split(panel).filter("part = 'test'")
    assert {(r.symbol, r.date) for r in rows} == {(r.symbol, r.next_date) for r in split.collect()}
    for r in rows:
        shares = {"UP": r.prob_up, "DOWN": r.prob_down, "NEUTRAL": r.prob_neutral}
        assert sum(shares.values()) == pytest.approx(1.0) and shares[r.signal] == max(shares.values())
    newest = max(r.date for r in rows)
    assert {r.date for r in G.latest_signals(signals).collect()} == {newest}
    assert G.signal_roster(signals).count() == 2
    assert sum(G.signal_counts(signals).first()) == G.latest_signals(signals).count()
    history = [r.date for r in G.signal_history(signals, "A").collect()]
    assert history == sorted(history) and len(history) == sum(r.symbol == "A" for r in rows)


def keeping(fits):
    """A fit that notes newest day and number of the training rows of each set, and leaves all sets unfitted."""

    def fit(rows, masks, settings):
        known = rows.filter("label is not null")
        fits.extend(known.filter(m).agg(F.max("next_date"), F.count(F.lit(1))).first() for m in masks)
        return K.fit_sets(rows, [F.lit(False)] * len(masks), settings)

    return fit


def test_rows_are_scored_by_models_of_older_rows_only(panel):
    split = stage(L.chrono_split(panel), "split")
    settings = ClassifierSettings(rounds=1, block_days=30)
    fits = []
    models = K.block_models(split, settings, keeping(fits))
    assert models.starts == K.block_starts(split.filter("part = 'test'"), 30) and len(models.starts) == len(fits) > 1
    for start, (newest, n) in zip(models.starts, fits):
        assert newest < start and n == split.filter(F.col("next_date") < F.lit(start)).count()
    # a short series that ends early has blocks of its own and takes no training row from the others
    early = split.filter("symbol = 'B'").limit(40).withColumns(
        {"symbol": F.lit("EARLY"), "part": F.lit("test"), "next_date": F.date_sub("next_date", 300)}
    )
    before, fits[:] = list(fits), []
    both = stage(split.unionByName(early), "both")
    K.block_models(both, settings, keeping(fits))
    assert [f[0] for f in fits[-len(before):]] == [f[0] for f in before]
    assert all(new[1] == old[1] + 40 for new, old in zip(fits[-len(before):], before))
    scored = K.score_blocks(both, settings)
    alone = scored.filter("symbol = 'EARLY'")
    assert alone.count() == 40 and scored.count() == both.filter("part = 'test'").count()
    first = K.with_block(early, 30).groupBy("block").count().orderBy("block").first()["count"]
    assert 0 < first < 40 and alone.filter("signal is null and prob_up is null").count() == first
    assert scored.filter("symbol <> 'EARLY' and signal is null").count() == 0


def test_newer_rows_do_not_change_a_block(panel):
    """Blocks fitted together equal a block fitted alone on its older rows."""
    split = stage(L.chrono_split(panel), "split")
    settings = ClassifierSettings(rounds=3, block_days=30)
    models = K.block_models(split, settings)
    for k in (0, len(models.starts) - 1):
        alone = train_classifier(stage(training_rows(split, models.starts[k]), "older"), settings)
        for name in ("base", "feature", "threshold", "value"):
            np.testing.assert_allclose(getattr(models.forest, name)[k], getattr(alone, name)[0], rtol=1e-9)


def test_queries_fit_every_block_on_its_own_older_rows(spark, panel, monkeypatch):
    """A series that ends early, and a panel without test rows, take nothing from the others' training rows."""
    split = L.chrono_split(panel)
    early = split.filter("symbol = 'B'").limit(40).withColumns(
        {"symbol": F.lit("EARLY"), "part": F.lit("test"), "next_date": F.date_sub("next_date", 100)}
    )
    both = stage(split.unionByName(early), "both")
    monkeypatch.setattr(M, "SETTINGS", ClassifierSettings(rounds=1, block_days=60))
    monkeypatch.setattr(M, "split_panel", lambda spark, folder: both)
    starts = K.block_starts(both.filter("part = 'test'"), 60)
    older = {s: both.filter(F.col("next_date") < F.lit(s)).count() for s in starts}
    rows = M.fit_classifier(spark, "").groupBy("block").agg(F.sum("n").alias("n")).collect()
    assert {r.block: r.n for r in rows} == {s: n for s, n in older.items() if n} and len(rows) > 1
    assert M.predict(spark, "").count() == both.filter("part = 'test'").count()
    bare = stage(split.filter("part = 'train'"), "bare")
    monkeypatch.setattr(M, "split_panel", lambda spark, folder: bare)
    assert M.fit_classifier(spark, "").count() == 0 and M.predict(spark, "").count() == 0
    assert M.model_store(spark, "").first().n == 0


def test_signal_views_over_generated_signals_equal_their_sql(spark, monkeypatch):
    monkeypatch.setattr(N, "ClassifierSettings", lambda: ClassifierSettings(rounds=1))
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = {q: catalog.load().queries[q] for q in ("signal_views", "generate_signals")}
    got = found["signal_views"](spark, folder).toPandas().sort_values("symbol", ignore_index=True)
    want = con.execute(catalog.load().sql["signal_views"]).df().sort_values("symbol", ignore_index=True)
    assert len(got) > 1 and (got["n_history"] > 1).all() and list(got["symbol"]) == list(want["symbol"])
    for column in want.columns:
        assert [str(x)[:10] for x in got[column]] == [str(x)[:10] for x in want[column]], column
    assert found["generate_signals"](spark, folder).count() == want["n_history"].sum()
    N._STORED.pop((spark.sparkContext.applicationId, folder, "generated"))


def test_queries_run_at_the_default_size(spark, panel, monkeypatch):
    used = []

    def keep(table, settings):
        used.append(settings)
        return table.limit(0)

    for name in ("labelled", "features"):
        monkeypatch.setattr(N, name, lambda spark, folder: panel.limit(1))
    for name in ("generate_signals", "forecast_trend"):
        monkeypatch.setattr(N, name, keep)
    N.signals(spark, ""), N.forecast(spark, "")
    assert used == [ClassifierSettings(), Q.QuantileSettings()] == [M.SETTINGS, M.SETTINGS_Q]
    assert [u.rounds for u in used] == [200, 150]


def test_models_are_reused_until_rows_or_settings_change(spark, panel):
    train, root, log = stage(training_rows(panel, dt.date(2020, 6, 1)), "train"), fresh_path(spark, "models"), []
    masks = [F.col("date") < F.lit(dt.date(2020, 4, 1)), F.lit(True)]
    fit = reusing(K.fit_sets, root, "all", log)
    first = fit(train, masks, FEW)
    again = fit(train.repartition(3, "close_usd"), masks, FEW)
    assert log == [False, True]
    for name in ("base", "feature", "threshold", "value", "fitted"):
        np.testing.assert_array_equal(getattr(first, name), getattr(again, name))
    assert again.step == first.step and again.fitted.tolist() == [True, True]
    fit(train, masks, ClassifierSettings(rounds=1))
    one = F.when(F.col("k") == 7, F.col("rsi") + 1e-9).otherwise(F.col("rsi"))
    fit(train.withColumn("rsi", one), masks, FEW)  # a corrected old row, the newest date is as before
    fit(train, [F.lit(True), F.lit(True)], FEW)
    fit(train.filter("k <> 3"), masks, FEW)
    fit(train.withColumn("label", F.when(F.col("k") != 2, F.col("label")).when(F.col("label") == "UP", "DOWN").otherwise("UP")), masks, FEW)
    assert log == [False, True] + [False] * 5
    assert fingerprint(train, masks) != fingerprint(train.unionByName(train.filter("k = 5")), masks)
    quantiles = reusing(Q.fit_quantile_sets, root, "all", log)
    quantiles(train, masks, (0.5,), settings=FEW_Q)
    quantiles(train, masks, (0.5,), settings=FEW_Q)
    quantiles(train, masks, (0.4,), settings=FEW_Q)
    assert log[-3:] == [False, True, False]


def test_half_written_models_are_not_seen(spark, panel, monkeypatch):
    path = fresh_path(spark, "half")
    assert load_forest(spark, path) is None
    forest = train_classifier(panel, ClassifierSettings(rounds=1))
    broken = B.Forest(forest.base, "no number", forest.feature, forest.threshold, forest.value, forest.fitted)
    with pytest.raises(Exception, match="no number|DoubleType|double"):
        save_forest(spark, broken, path)  # trees are written, the manifest is not
    assert load_forest(spark, path) is None
    save_forest(spark, forest, path)
    save_forest(spark, forest, path)  # a second writer
    np.testing.assert_array_equal(load_forest(spark, path).value, forest.value)


def test_one_missing_class_gets_probability_zero(panel):
    two = panel.filter("label <> 'NEUTRAL'")
    forest = train_classifier(two, FEW)
    assert generate_signals(panel, FEW, forest).filter("prob_neutral <> 0").count() == 0
    alone = train_classifier(panel.filter("label = 'UP'"), FEW)
    assert generate_signals(panel, FEW, alone).filter("prob_up <> 1 or signal <> 'UP'").count() == 0


def test_missing_features_are_lowest(panel):
    holed = panel.withColumn("rsi", F.when(F.col("k") % 3 > 0, F.col("rsi")))
    low = panel.withColumn("rsi", F.when(F.col("k") % 3 > 0, F.col("rsi")).otherwise(-1e9))
    forest = train_classifier(holed, FEW)
    one, two = (K.with_probabilities(p, forest).select("symbol", "k", "prob_up") for p in (holed, low))
    assert one.join(two.withColumnRenamed("prob_up", "other"), ["symbol", "k"]).filter("prob_up <> other or prob_up is null").count() == 0


def numpy_rows(panel):
    rows = K.weighted_sets(panel, [F.lit(True), F.col("date") < F.lit(dt.date(2020, 7, 1))])
    return rows.select("y", "draw", "w", *X.FEATURES).toPandas(), rows


def test_histograms_equal_a_numpy_walk(panel):
    """Splits, leaves and scores of whole rounds against a plain walk over the rows."""
    table, rows = numpy_rows(panel)
    growth, loss = B.Growth(rounds=3, step=0.1, depth=2, min_leaf=10, bins=16, store_every=2), B.Softmax(3)
    forest = B.fit_forest(stage(rows, "rows"), 2, loss, growth)
    cuts = B.feature_cuts(rows, 2, 16)
    for s in (0, 1):
        w = np.array(table["w"].to_list())[:, s]
        own = w > 0
        x, y, w = table[X.FEATURES].to_numpy()[own], table["y"].to_numpy()[own], w[own]
        sums = np.array([w[y == c].sum() for c in range(3)])
        np.testing.assert_allclose(forest.base[s], np.log(sums / sums.sum()))
        score = np.repeat(forest.base[s][:, None], len(y), axis=1)
        for number in range(3):
            p = np.exp(score) / np.exp(score).sum(axis=0)
            for c in range(3):
                g, h = (np.round(v * 2**20) / 2**20 for v in (w * (p[c] - (y == c)), w * p[c] * (1 - p[c])))
                feature, threshold = forest.feature[s, c, number], forest.threshold[s, c, number]
                members = {0: np.arange(len(y))}
                for node in range(3):
                    at = members[node]
                    best, gained = (0, np.inf), 0.0
                    for f in range(16):
                        for cut in cuts[s, f][np.isfinite(cuts[s, f])]:
                            left = at[x[at, f] <= cut]
                            right = at[x[at, f] > cut]
                            if min(len(left), len(right)) < 10:
                                continue
                            gain = sum(g[k].sum() ** 2 / h[k].sum() for k in (left, right)) - g[at].sum() ** 2 / h[at].sum()
                            if gain > gained + 1e-9:
                                best, gained = (f, cut), gain
                    assert (feature[node], threshold[node]) == best
                    goes = x[at, best[0]] <= best[1]
                    members[2 * node + 1], members[2 * node + 2] = at[goes], at[~goes]
                for leaf in range(4):
                    at = members[leaf + 3]
                    value = -g[at].sum() / h[at].sum() if len(at) else 0.0
                    assert forest.value[s, c, number, leaf] == pytest.approx(value, abs=1e-9)
                    score[c, at] += 0.1 * value
        np.testing.assert_allclose(forest.scores(x, s).T, score, atol=1e-9)


def test_fits_do_not_depend_on_partitions(panel):
    _, rows = numpy_rows(panel)
    growth = B.Growth(rounds=2, step=0.1, depth=3, min_leaf=5)
    one, two = (B.fit_forest(stage(rows.repartition(n, "lag1"), "rows"), 2, B.Softmax(3), growth) for n in (1, 5))
    np.testing.assert_array_equal(one.feature, two.feature)
    np.testing.assert_array_equal(one.value, two.value)


def test_leaves_hold_quantiles_of_residuals():
    loss = B.Quantiles((0.1, 0.5, 0.9))
    rng = np.random.default_rng(1)
    residual = np.concatenate([rng.normal(0, 0.03, 5000), [0.0] * 50, [1e-12, -1e-12]])
    counts = np.bincount(loss.place(residual), minlength=loss.places)[None, None, None].repeat(3, axis=1)
    got = loss.leaf_values(counts)[0, :, 0]
    want = np.quantile(residual, [0.1, 0.5, 0.9], method="inverted_cdf")
    np.testing.assert_allclose(got, want, rtol=0.011, atol=1e-9)
    assert loss.leaf_values(np.zeros((1, 3, 2, loss.places), int)).tolist() == [[[0, 0]] * 3]


def test_many_tasks_add_up_in_a_tree(spark):
    numbers = spark.sparkContext.parallelize(range(200), 100)
    assert B._added(numbers, lambda part: np.array([sum(part), 1])).tolist() == [19900, 100]


def test_the_driver_gets_splits_and_no_histograms(panel, monkeypatch):
    """What a round sends to the driver is small and the same for any number of tasks."""
    rows = stage(numpy_rows(panel)[1], "rows")
    fetched, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: fetched.append(collect(self)) or fetched[-1])
    sent = {}
    for loss in (B.Softmax(3), B.Quantiles(C.QUANTILES)):
        for tasks in (1, 12):
            chunks = B.packed(rows).rdd.flatMap(B._split_sets(B.feature_cuts(rows, 2, 64), np.zeros((2, 3)))).repartition(tasks)
            fetched.clear()
            B.grow_round(chunks, loss, [], 0, B.Growth(rounds=1, step=0.1, depth=3), (2, 3))
            sent[loss, tasks] = sum(len(pickle.dumps(value)) for value in fetched)
        assert 0 < sent[loss, 12] < 1.2 * sent[loss, 1] < 10_000


def test_walk_forward(panel):
    rows = {r.symbol: r for r in walk_forward_eval(panel, FEW).collect()}
    assert set(rows) == {"A", "B"}
    for r in rows.values():
        assert r.n_up + r.n_down + r.n_neutral == r.n_days - 31 and r.status == "OK"
        assert all(0 <= v <= 1 for v in (r.f1_weighted, r.f1_macro, r.dir_accuracy, r.auc_roc))


def test_walk_forward_counts_rows_it_cannot_score(panel):
    late = panel.withColumn("next_date", F.col("next_date") + F.when(F.col("symbol") == "B", 0).otherwise(0))
    rows = {r.symbol: r for r in walk_forward_eval(late, ClassifierSettings(rounds=1, block_days=100_000)).collect()}
    for symbol, n in (("A", 260 - 31), ("B", 220 - 31)):
        assert rows[symbol].n_unscored == 3 * (n // 4) and rows[symbol].f1_macro is None


def test_boosting_lowers_the_loss(panel, quantile_models):
    for model in quantile_models:
        y = F.col("next_return")
        row = Q.predict_quantile(panel, model, "guess").agg(
            Q.pinball(y, F.col("guess"), model.alpha), Q.pinball(y, F.lit(model.base), model.alpha)
        ).first()
        assert row[0] < row[1] and model.rounds == 3


def test_one_quantile_alone_is_the_same_model(panel, quantile_models):
    alone = Q.quantile_boost(panel, 0.5, settings=FEW_Q)
    np.testing.assert_array_equal(alone.forest.value[0, 0], quantile_models[1].forest.value[0, 1])
    np.testing.assert_array_equal(alone.forest.threshold[0, 0], quantile_models[1].forest.threshold[0, 1])


def test_matrix_and_column_forms_of_the_trees_agree(panel, quantile_models):
    wide = panel
    for k, model in enumerate(quantile_models):
        wide = Q.predict_quantile(wide, model, f"q{k}")
    rows = wide.select(*X.FEATURES, "q0", "q1", "q2").toPandas()
    forest = quantile_models[0].forest
    for row in rows.to_numpy()[:50]:
        for j in range(3):
            out = forest.base[0, j]
            for feature, threshold, value in zip(forest.feature[0, j], forest.threshold[0, j], forest.value[0, j]):
                node = 0
                while node < len(feature):
                    node = 2 * node + 1 + (row[feature[node]] > threshold[node])
                out += forest.step * value[node - len(feature)]
            assert row[16 + j] == pytest.approx(out, abs=1e-12)


def test_rollout_follows_the_training_definitions(spark, usd_series, frame, quantile_models):
    """Every step must see what a feature frame computed over the extended series shows, frozen inputs aside."""
    cone = {r.date: r for r in C.recursive_rollout(frame, quantile_models, 5).filter("symbol = 'A'").collect()}
    assert len(cone) == 5
    prices = prices_of(260, 1)
    predict = lambda x: quantile_models[0].forest.scores(x, 0)
    frozen = None
    low = mid = high = prices[-1]
    for t in range(5):
        last = X.feature_frame(usd_series({"A": prices})).orderBy(F.desc("i")).first()
        x = np.array([[last[c] for c in X.FEATURES]])
        frozen = x[0, 13:] if frozen is None else frozen
        x[0, 13:] = frozen
        q10, q50, q90 = np.clip(predict(x)[0], -0.2, 0.2)
        fade = np.exp(-t / 180)
        low *= 1 + min(q50, q50 + (q10 - q50) * fade)
        mid *= 1 + q50
        high *= 1 + max(q50, q50 + (q90 - q50) * fade)
        prices.append(float(mid))
        row = cone[last.date + dt.timedelta(days=1)]
        np.testing.assert_allclose([row.predicted_p10, row.predicted_p50, row.predicted_p90], [low, mid, high], rtol=1e-6)


def test_forecast(frame):
    rows = C.forecast_trend(frame, FEW_Q).collect()
    assert {r.symbol for r in rows} == {"A", "B"} and len(rows) == 730
    assert all(0 < r.predicted_p10 <= r.predicted_p50 <= r.predicted_p90 for r in rows)
    days = sorted(r.date for r in rows if r.symbol == "A")
    assert days == [dt.date(2020, 1, 1) + dt.timedelta(days=260 + k) for k in range(365)]


def test_forecast_of_short_series_is_empty(frame):
    cones = C.forecast_trend(frame.filter("symbol = 'A' and i < 20"), FEW_Q)
    assert cones.count() == 0 and "predicted_p50" in cones.columns


def test_series_without_older_rows_are_named(frame):
    settings = Q.QuantileSettings(rounds=1, block_days=100_000)
    models = C.forecast_models(frame, settings)
    assert {tuple(r) for r in C.series_sets(frame, models, settings).collect()} == {("A", None), ("B", None)}
    assert C.forecast_trend(frame, settings, models=models).count() == 0


def test_many_trees_predict_without_code_limits(panel, quantile_models):
    model = quantile_models[1]
    f = model.forest
    feature, threshold, value = (np.concatenate([a] * 60, axis=2) for a in (f.feature, f.threshold, f.value))
    big = Q.QuantileModel(model.alpha, B.Forest(f.base, f.step, feature, threshold, value, f.fitted), 0, model.output)
    once = Q.predict_quantile(panel, model, "a").agg(F.avg(F.col("a") - model.base)).first()[0]
    many = Q.predict_quantile(panel, big, "a").agg(F.avg(F.col("a") - model.base)).first()[0]
    assert many == pytest.approx(60 * once)


def test_cone_with_floor_equals_stepping(spark):
    rng = np.random.default_rng(0)
    n = 200
    raw = np.column_stack([rng.uniform(-0.9, 0.1, n), rng.uniform(-0.2, 0.1, n), rng.uniform(-0.1, 0.5, n)])
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=t), t, *map(float, raw[t]), 1e-6) for t in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date date, t int, q10 double, q50 double, q90 double, start double")
    got = C.forecast_cone(df).orderBy("date").collect()
    chain = np.array([1e-6] * 3)
    for t in range(n):
        q10, q50, q90 = np.clip(raw[t], -0.2, 0.2)
        fade = np.exp(-t / 180)
        r = np.array([min(q50, q50 + (q10 - q50) * fade), q50, max(q50, q50 + (q90 - q50) * fade)])
        chain = np.maximum(chain * (1 + r), 1e-9)
        np.testing.assert_allclose([got[t].ln_p10, got[t].ln_p50, got[t].ln_p90], np.log(chain), atol=1e-9)
