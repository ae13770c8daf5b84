import random

import numpy as np
import pytest

from tickerloom.operators import evaluation as V

CLASSES = ["UP", "DOWN", "NEUTRAL"]


def brute(rows):
    truth = np.array([r[1] for r in rows])
    pred = np.array([r[2] for r in rows])
    score = np.array([r[3:] for r in rows], dtype=float)
    f1, support = {}, {}
    for c in set(truth) | set(pred):
        tp = np.sum((truth == c) & (pred == c))
        p = tp / np.sum(pred == c) if np.sum(pred == c) else 0.0
        r = tp / np.sum(truth == c) if np.sum(truth == c) else 0.0
        f1[c], support[c] = (2 * p * r / (p + r) if p + r else 0.0), np.sum(truth == c)
    sided = (truth != "NEUTRAL") & (pred != "NEUTRAL")
    acc = np.mean(truth[sided] == pred[sided]) if sided.any() else 0.5
    areas = []
    for k, c in enumerate(CLASSES):
        pos, neg = score[truth == c, k], score[truth != c, k]
        if len(pos) and len(neg):
            wins = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
            areas.append((wins.mean(), len(pos)))
    auc = sum(a * n for a, n in areas) / len(rows) if len(areas) == 3 else 0.0
    weighted = sum(f1[c] * support[c] for c in f1) / len(rows)
    return weighted, np.mean(list(f1.values())), acc, auc


def random_rows(seed, classes=CLASSES, n=80):
    rng = np.random.default_rng(seed)
    return [
        (f"S{seed}", str(rng.choice(classes)), str(rng.choice(CLASSES)), *np.round(rng.uniform(size=3), 1).tolist())
        for _ in range(n)
    ]


def test_metrics_match_brute_force(spark):
    groups = [random_rows(0), random_rows(1, ["UP", "DOWN"]), random_rows(2, ["NEUTRAL"], 10), random_rows(3, n=5)]
    schema = "symbol string, label string, prediction string, score_up double, score_down double, score_neutral double"
    df = spark.createDataFrame([r for g in groups for r in g], schema)
    f1 = {r.symbol: r for r in V.f1_scores(df, ["symbol"]).collect()}
    acc = {r.symbol: r.dir_accuracy for r in V.directional_accuracy(df, ["symbol"]).collect()}
    auc = {r.symbol: r.auc_roc for r in V.auc_ovr_weighted(df, ["symbol"]).collect()}
    for group in groups:
        name = group[0][0]
        got = (f1[name].f1_weighted, f1[name].f1_macro, acc[name], auc[name])
        assert got == pytest.approx(brute(group), abs=1e-12), name


def test_summary_and_cuts(spark):
    rows = [(f"S{k}", 0.4 + k / 100, 0.5, 0.5 + k / 200, 0.55, 0.0, 0.0) for k in range(11)]
    df = spark.createDataFrame(rows, "symbol string, f1_weighted double, f1_macro double, dir_accuracy double, auc_roc double, rmse double, mae double")
    counts = V.threshold_counts(df).first()
    assert (counts.f1_good, counts.dir_50, counts.dir_52, counts.dir_55, counts.auc_good) == (1, 11, 7, 1, 11)
    summary = V.metric_summary(df).first()
    assert summary.med_f1_w == pytest.approx(0.45) and summary.avg_f1_w == pytest.approx(0.45)
    everything = spark.createDataFrame([(f"S{k}",) for k in range(14)] * 2, "symbol string")
    assert tuple(V.filtered_out_count(everything, df).first()) == (14, 11, 3)


def test_one_pass_equals_the_single_metrics(spark):
    """Ties, classes never seen or never called, and keys of one row."""
    rng = random.Random(9)
    rows = []
    for key in range(30):
        labels = rng.sample(CLASSES, rng.randint(1, 3))
        calls = rng.sample(CLASSES, rng.randint(1, 3))
        for _ in range(rng.choice([1, 2, 5, 40])):
            rows.append((f"S{key}", key % 3, rng.choice(labels), rng.choice(calls), *(float(rng.randint(0, 4)) for _ in range(3))))
    schema = "symbol string, fold int, label string, prediction string, score_up double, score_down double, score_neutral double"
    df, keys = spark.createDataFrame(rows, schema), ["symbol", "fold"]
    one = V.all_metrics(df, keys)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    single = V.f1_scores(df, keys).join(V.directional_accuracy(df, keys), keys).join(V.auc_ovr_weighted(df, keys), keys)
    names = ["f1_weighted", "f1_macro", "dir_accuracy", "auc_roc"]
    got, want = ({r.symbol: [r[n] for n in names] for r in x.collect()} for x in (one, single))
    assert set(got) == set(want)
    for symbol in got:
        assert got[symbol] == pytest.approx(want[symbol], abs=1e-12)
