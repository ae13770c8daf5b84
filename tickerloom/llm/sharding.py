"""Shards of nearly equal bytes by Karmarkar-Karp differencing of indivisible groups.

Equal texts are a group and stay together. Differencing keeps partial partitions, at first one for each item, and again and
again combines the two with the largest spread so that the fullest part of one meets the emptiest of the other. That is one
sequence over all items, so its items are kept few whatever the corpus: groups of at least a grain (a fixed share of all
bytes) are items of their own, smaller groups are bundled by hash. What is left over between shards is far below a grain.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.workspace import stage

#: Bundles of small groups, and at most as many groups that reach the grain.
BUNDLES = 8192
#: Places in which a shard's rows are numbered side by side.
LANES = 1024
#: Slots of equal rows written out at a time.
STRETCH = 10_000


def difference(sizes: list[int], parts: int) -> list[int]:
    """Part of each size, by largest differencing: deterministic, equal spreads go in order of the sizes given."""
    if not sizes:
        return []
    # a partial partition: -spread, order, [(bytes above the emptiest part, members)], emptiest first
    heap = [(-size, n, [(0, [])] * (parts - 1) + [(size, [n])]) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, one = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        joined = [(x + y, _joined(m, n)) for (x, m), (y, n) in zip(one, reversed(other))]
        joined.sort(key=lambda part: part[0])
        low = joined[0][0]
        joined = [(size - low, members) for size, members in joined]
        heapq.heappush(heap, (-joined[-1][0], first, joined))
    found = [0] * len(sizes)
    for part, (_, members) in enumerate(heap[0][2]):
        for n in members:
            found[n] = part
    return found


def _joined(one: list[int], other: list[int]) -> list[int]:
    """Both lists as one; the longer is extended, so that all joins together copy each member a few times only."""
    if not other:
        return one
    if not one:
        return other
    if len(one) < len(other):
        one, other = other, one
    one.extend(other)
    return one


def _place(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.Table.from_batches(batches, pa.schema([("kind", pa.int32()), ("item", pa.int64()), ("bytes", pa.int64())]))
        items = items.sort_by([("bytes", "descending"), ("kind", "ascending"), ("item", "ascending")])
        shards = pa.array(difference(items.column("bytes").to_pylist(), parts), pa.int32())
        yield from items.drop_columns("bytes").append_column("shard", shards).to_batches()

    return run


def place_groups(groups: DataFrame, parts: int, bundles: int = BUNDLES) -> DataFrame:
    """``kind, item, shard`` for a table ``key, bytes`` with one row per group: kind 0 are bundles (``item`` is the key modulo
    ``bundles``), kind 1 single groups (``item`` is the key). At most twice ``bundles`` rows, so one task differences them."""
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("all")).first()["all"]
    grain = max(1, -(-total // bundles))  # at most ``bundles`` groups are as large as that
    single = F.col("bytes") >= grain
    item = F.when(single, F.col("key")).otherwise(F.pmod("key", F.lit(bundles)))
    items = groups.groupBy(single.cast("int").alias("kind"), item.alias("item")).agg(F.sum("bytes").alias("bytes"))
    return stage(items.repartition(1).mapInArrow(_place(parts), "kind int, item long, shard int"), "places")


def shard_documents(docs: DataFrame, parts: int = 16, bundles: int = BUNDLES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``; other columns are ignored): ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 bytes of the text plus 1, ``text_crc32`` unsigned; a null text has size 1 and the CRC of no bytes,
    and all null texts are a group. Equal texts share a shard, so a group larger than a shard's share makes that shard larger;
    all else is spread so that shards are nearly equal. ``slot`` numbers the rows of a shard from 0 without a gap, in an order
    that depends on the rows alone; reruns agree. Repeated rows are rows of their own, ids may be null and of any type. An
    empty table gives an empty table.

    Texts are read once. Groups, shards and slots come from a narrow table of (id, group) pairs with their number of rows,
    and a hot group's rows are numbered in ``LANES`` places side by side.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    # texts with one hash by chance would only share a shard
    key = F.xxhash64(text.isNull(), text)
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), key.alias("key"))
    rows = stage(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times")), "rows")
    groups = rows.groupBy("key").agg(F.sum(F.col("size") * F.col("times")).alias("bytes"))
    places = place_groups(stage(groups, "groups"), parts, bundles)
    single = F.broadcast(places.filter("kind = 1").select(F.col("item").alias("key"), F.col("shard").alias("own")))
    bundle = F.broadcast(places.filter("kind = 0").select(F.col("item").alias("bundle"), F.col("shard").alias("shared")))
    placed = rows.join(single, "key", "left").join(bundle, F.pmod("key", F.lit(bundles)) == F.col("bundle"), "left")
    lane = F.pmod(F.xxhash64("doc_id", "key"), F.lit(LANES))
    placed = placed.select(*rows.columns, F.coalesce("own", "shared").alias("shard"), lane.alias("lane"))
    lanes = placed.groupBy("shard", "lane").agg(F.sum("times").alias("n"))  # at most parts * LANES rows
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lanes.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "lane").orderBy("key", "doc_id", "size", "text_crc32")
    earlier = F.coalesce(F.sum("times").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("earlier", earlier).join(F.broadcast(offsets), ["shard", "lane"])
    first = F.col("before") + F.col("earlier")
    spans = numbered.withColumns({"first": first, "last": first + F.col("times") - 1})
    # rows that are equal in all columns are told apart by their slots alone; in two steps, so that no array grows with them
    spans = spans.withColumn("start", F.explode(F.sequence("first", "last", F.lit(STRETCH).cast("long"))))
    slots = F.sequence("start", F.least("last", F.col("start") + (STRETCH - 1)))
    return spans.select("doc_id", "size", "text_crc32", "shard", F.explode(slots).alias("slot"))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = shard_documents(spark.read.parquet(f"{folder}/documents.parquet"), 16)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op13_sharding": op13_sharding}
SQL = {}
