"""A registry of fitted forests on shared storage, reused while training rows and settings stay the same."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.learning.boosting import Forest
from tickerloom.operators.features import FEATURES

TREES = "set int, output int, round int, feature array<int>, threshold array<double>, value array<double>"
MANIFEST = "trees string, n_trees long, step double, outputs int, rounds int, splits int, base array<array<double>>, fitted array<boolean>"
Fit = Callable[..., Forest]


def fingerprint(rows: DataFrame, masks: list[Column]) -> str:
    """Count and order-free hashes of everything a fit reads of its rows: keys, features, targets and masks. Any changed,
    added or missing row gives another value; the order of rows and their partitions do not matter."""
    read = [F.col(c) for c in ("symbol", "date", "next_date", "label", "next_return", "k", "n") if c in rows.columns]
    values = [*read, *[F.col(c) for c in FEATURES], *[F.coalesce(m, F.lit(False)) for m in masks]]
    nulls = F.concat_ws("", *[v.isNull().cast("int").cast("string") for v in values])  # a null leaves a hash as it is
    one, two = F.xxhash64(nulls, *values), F.xxhash64(F.lit("again"), nulls, *values)
    found = rows.agg(
        F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)")), F.bit_xor(one)
    ).first()
    return repr(tuple(found))


def model_key(rows: DataFrame, masks: list[Column], *settings: object) -> str:
    """Name of a fit: inputs, settings and the fingerprint of its rows."""
    return hashlib.sha256(repr((FEATURES, settings, fingerprint(rows, masks))).encode()).hexdigest()[:24]


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """Trees first, then a manifest that names them. Both appear at once when their job commits, so a set that is half
    written, or a second writer, is never seen."""
    trees = f"{path}/trees-{uuid.uuid4().hex}"
    rows = [
        (k, j, r, *(a[k, j, r].tolist() for a in (forest.feature, forest.threshold, forest.value)))
        for k, j, r in np.ndindex(*forest.feature.shape[:3])
    ]
    spark.createDataFrame(rows, TREES).repartition(1).write.parquet(trees)
    head = (trees, len(rows), forest.step, *forest.feature.shape[1:], forest.base.tolist(), forest.fitted.tolist())
    spark.createDataFrame([head], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest-{uuid.uuid4().hex}")


def load_forest(spark: SparkSession, path: str) -> Forest | None:
    """The stored forest, or None where no manifest is complete."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{path}/manifest-*").orderBy("trees").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if found is None:
        return None
    base = np.array(found.base, float).reshape(len(found.fitted), found.outputs)
    shape = (*base.shape, found.rounds)
    rows = spark.read.schema(TREES).parquet(found.trees).collect()  # as many as the settings say
    if len(rows) != found.n_trees:
        raise ValueError(f"{found.trees}: {len(rows)} of {found.n_trees} trees")
    forest = Forest(
        base, found.step, np.zeros((*shape, found.splits), np.int64), np.zeros((*shape, found.splits)),
        np.zeros((*shape, found.splits + 1)), np.array(found.fitted, bool),
    )
    for r in rows:
        at = (r.set, r.output, r.round)
        forest.feature[at], forest.threshold[at], forest.value[at] = r.feature, r.threshold, r.value
    return forest


def reusing(fit: Fit, root: str, scope: str, log: list[bool] | None = None) -> Fit:
    """A form of ``fit`` that looks in the registry below ``root`` first. ``log`` gets whether each forest was there."""

    def run(rows: DataFrame, masks: list[Column], *args: object, **more: object) -> Forest:
        spark = rows.sparkSession
        key = model_key(rows, masks, scope, [str(m) for m in masks], args, sorted(more.items()))
        path = f"{root.rstrip('/')}/models/{scope}/{key}"
        found = load_forest(spark, path)
        if log is not None:
            log.append(found is not None)
        if found is None:
            found = fit(rows, masks, *args, **more)
            save_forest(spark, found, path)
        return found

    return run
