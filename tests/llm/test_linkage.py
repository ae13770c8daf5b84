"""Classes from buckets: the same with links that come late, few jobs without any, and joins that the JVM compiles."""

import re

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import hyperminhash, line_dedup
from tickerloom.llm.linkage import _crossing_pairs, _leader_pairs, link_buckets
from tickerloom.workspace import stage


def linked(spark, rows, name):
    """Classes of nodes whose ``name`` is equal, and the jobs that took."""
    buckets = stage(spark.createDataFrame(rows, "bucket long, node long"), "buckets")
    group = f"linkage {name}"
    spark.sparkContext.setJobGroup(group, group)
    found = link_buckets(buckets, lambda pairs: pairs.filter(F.expr(name.format("a")) == F.expr(name.format("b"))))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return {r.node: r.component for r in found.collect()}, jobs


def test_classes_are_not_built_anew_without_new_links(spark):
    """In each bucket five nodes are one class and the others stand alone, which the first comparison finds."""
    rows = [(b, 20 * b + k) for b in range(4) for k in range(9)]
    got, jobs = linked(spark, rows, "if({0} % 20 < 5, {0} div 20, -{0})")
    assert got == {20 * b + k: 20 * b for b in range(4) for k in range(5)}
    assert jobs <= 45


@pytest.mark.parametrize("classes", [3, 25])
def test_links_found_late_join_the_classes(spark, classes):
    """One bucket of many classes: the smallest node and the picked ones are members of a few of them only."""
    rows = [(0, n) for n in range(4 * classes)] + [(1, n) for n in range(1, 4 * classes, 2)]
    got, _ = linked(spark, rows, f"{{0}} % {classes}")
    assert got == {n: n % classes for n in range(4 * classes)}


@pytest.mark.parametrize("pairs", [_leader_pairs, _crossing_pairs])
@pytest.mark.parametrize(
    "possible, names",
    [
        (hyperminhash._can_reach(hyperminhash.NearSettings()), [f"p{k}" for k in range(hyperminhash.PARTS)]),
        (line_dedup._may_be_near(2), list(line_dedup.LETTERS)),
    ],
)
def test_bounds_of_pairs_are_short_enough_to_be_compiled(spark, capsys, pairs, possible, names):
    """The JVM interprets methods of more than 8,000 bytes however often they run."""
    facts = F.struct(F.lit(100).cast("long").alias("size"), *[F.lit(3).alias(c) for c in names])
    rows = spark.range(40).select(F.col("id").alias("node"), F.col("id").alias("component"), F.expr("id % 4 AS bucket"), facts.alias("facts"))
    rows = stage(rows, "rows")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pairs(rows, possible)
        found.collect()  # the plan that ran has the code
        found.explain("codegen")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
