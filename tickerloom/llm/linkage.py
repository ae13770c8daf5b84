"""Classes of linked items from buckets of candidates, without writing all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.contagion import star_forest
from tickerloom.workspace import stage

Verify = Callable[[DataFrame], DataFrame]
Possible = Callable[[Column, Column, Column], Column]


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _members(forest: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of a forest but the smallest of each class."""
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _still_open(buckets: DataFrame, forest: DataFrame) -> DataFrame:
    """Rows of buckets that still hold several classes, with the class of each node."""
    named = buckets.join(_members(forest), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return stage(named.join(mixed.select("bucket"), "bucket"), "open")


def _anything(x: Column, low: Column, high: Column) -> Column:
    return F.lit(True)


def _pairs(rows: DataFrame, leader: str) -> DataFrame:
    pairs = rows.filter(F.col(leader) != F.col("node"))
    return pairs.select(F.least(leader, "node").alias("a"), F.greatest(leader, "node").alias("b")).distinct()


def _definite(rows: DataFrame) -> DataFrame:
    """The same rows with facts that cannot be null. Spark then leaves out the tests for nulls; with them the code of a join on
    ``possible`` is a method of over 8,000 bytes, which the JVM interprets for every pair and never compiles."""
    names = rows.schema["facts"].dataType.names
    return rows.withColumn("facts", F.struct(*[F.coalesce(f"facts.{c}", F.lit(0)).alias(c) for c in names]))


def _leader_pairs(rows: DataFrame, possible: Possible) -> DataFrame:
    """Members of each open bucket paired with six members of other classes, picked by hash."""
    rows, member = _definite(rows), F.struct("node", "component", "facts")
    picks = []
    for salt in range(3):
        order = F.struct(F.xxhash64("node", "bucket", F.lit(salt)), F.col("node"))
        picks += [F.min_by(member, order), F.max_by(member, order)]
    leaders = rows.groupBy("bucket").agg(F.array(*picks).alias("leaders"))
    near = rows.join(leaders, "bucket").select("node", "component", "facts", F.explode("leaders").alias("leader"))
    near = near.filter("leader.component <> component").filter(possible(F.col("facts"), F.col("leader.facts"), F.col("leader.facts")))
    return _pairs(near.select("node", F.col("leader.node").alias("leader")), "leader")


def _crossing_pairs(rows: DataFrame, possible: Possible) -> DataFrame:
    """All pairs of different classes in one bucket that are possible: first a node against a class, then the two nodes."""
    rows = _definite(rows)
    names = rows.schema["facts"].dataType.names
    bounds = [F.struct(*[f(F.col(f"facts.{c}")).alias(c) for c in names]).alias(k) for f, k in ((F.min, "low"), (F.max, "high"))]
    classes = rows.groupBy("bucket", F.col("component").alias("other")).agg(*bounds).withColumnRenamed("bucket", "in")
    reach = (F.col("bucket") == F.col("in")) & (F.col("other") > F.col("component"))
    crossed = rows.join(classes, reach & possible(F.col("facts"), F.col("low"), F.col("high")))
    crossed = crossed.select("bucket", "other", F.col("node").alias("x"), F.col("facts").alias("fx"))
    facing = rows.select(
        F.col("bucket").alias("met"), F.col("component").alias("class"), F.col("node").alias("y"), F.col("facts").alias("fy")
    )
    meet = (F.col("bucket") == F.col("met")) & (F.col("other") == F.col("class")) & possible(F.col("fx"), F.col("fy"), F.col("fy"))
    return crossed.join(facing, meet).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_buckets(
    buckets: DataFrame,
    verify: Verify,
    facts: Callable[[DataFrame], DataFrame] | None = None,
    possible: Possible | None = None,
    given: DataFrame | None = None,
) -> DataFrame:
    """``node, component`` of every node that has a link, exact with respect to the buckets: two nodes that share a bucket
    and pass ``verify`` end in one class.

    ``buckets`` (``bucket, node``, stored) names candidates; ``verify`` keeps those rows of a table of pairs ``a < b`` that
    are links. First every member is compared with its bucket's smallest node, then with a few members of other classes; a
    bucket whose members form one class is done. What is left are pairs of different classes in one bucket. They are
    compared one by one, except those that ``possible`` rules out while they are joined: first a node against a class,
    then the two nodes. It sees the node's ``facts`` (``node, facts``, a row for each of a table of open nodes, a struct of numbers)
    and the least and greatest of the other side's. ``given`` are links (``a, b``) that hold from the start. A group of n copies costs a few n comparisons and those of its
    outliers rather than n * n. Classes found so far are kept as a forest to which new links are added; without any the
    forest stands, since the driver's memory follows the number of plans of a session.
    """
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    shared = stage(buckets.join(shared.filter("leader <> last").select("bucket", "leader"), "bucket"), "shared")
    links = verify(_pairs(shared, "leader"))
    links = stage(links if given is None else links.unionByName(given), "links")
    forest, possible = star_forest(_edges(links)), possible or _anything
    rows = _still_open(shared.select("bucket", "node"), forest)
    if not rows.isEmpty():
        nodes = rows.select("node").distinct()
        known = facts(nodes) if facts else nodes.withColumn("facts", F.struct(F.lit(0).alias("none")))
        rows = stage(rows.join(known, "node"), "open")
        new = stage(verify(_leader_pairs(rows, possible)), "links")
        if not new.isEmpty():
            forest = star_forest(forest.unionByName(_edges(new)))
            rows = _still_open(rows.drop("component"), forest)
        new = stage(verify(_crossing_pairs(rows, possible)), "links")
        if not new.isEmpty():
            forest = star_forest(forest.unionByName(_edges(new)))
    roots = forest.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return _members(forest).unionByName(roots)
