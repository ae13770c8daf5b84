"""Near-duplicate documents by HyperMinHash.

A document's word shingles fall into registers by hash. A register keeps the smallest hash of its shingles as the count of
leading zeros and the mantissa bits after them, 16 bits in all; empty registers borrow from others. Bands of registers
name candidates, register agreement corrected for chance collisions estimates the Jaccard similarity, and pairs that can
still reach the threshold are verified on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.filters import semi_filter
from tickerloom.llm.linkage import link_buckets
from tickerloom.llm.words import blocks, mix, shingle_sets
from tickerloom.workspace import stage


PARTS = 32
BLOCK = 1 << 19  # bytes of text a task works on at a time
#: What names a node: its number, the smallest id of a row with its set, and the set's 128-bit name.
NAME = ["node", "first", "s1", "s2"]


@dataclass(frozen=True)
class NearSettings:
    """Similarity is at least ``percent`` of 100 over shingles of ``words`` words. ``bands`` of ``rows`` registers: a pair at
    85 is missed by all 32 bands of 5 with a chance of 7e-9, at 80 by all 40 bands of 4 with one of 6e-10. ``slack`` are
    the standard errors an estimate may lie below the threshold."""

    words: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 5
    mantissa: int = 10
    slack: float = 6.0

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers_of(values: np.ndarray, offsets: np.ndarray, settings: NearSettings) -> np.ndarray:
    """Registers (uint16) of every set, one row each; sets without members give zeros."""
    k, n = settings.registers, len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    spread = mix(values ^ np.uint64(0xA5A5A5A5_5A5A5A5A))
    cell = owner * k + ((spread >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    low = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, cell, mix(spread + np.uint64(0x632BE59BD9B4E019)))
    low = low.reshape(n, k)
    empty = low == np.iinfo(np.uint64).max
    live = np.diff(offsets) > 0
    # densification: an empty register copies the first filled one on its own pseudo-random path
    steps = mix(np.arange(k, dtype=np.uint64)[None, :] * np.uint64(1_000_003) + np.arange(1, 65, dtype=np.uint64)[:, None])
    steps = (steps % np.uint64(k)).astype(np.int64)
    pending, source = empty & live[:, None], low.copy()
    for step in steps:
        if not pending.any():
            break
        row, col = np.nonzero(pending)
        found = ~empty[row, step[col]]
        row, col = row[found], col[found]
        low[row, col] = mix(source[row, step[col]] + np.uint64(1))
        pending[row, col] = False
    for row, col in zip(*np.nonzero(pending)):  # sparse sets whose paths all missed: the next filled register
        filled = np.flatnonzero(~empty[row])
        near = filled[np.searchsorted(filled, [col]) % len(filled)]
        low[row, col] = mix(source[row, near] + np.uint64(1))[0]
    return compress(low, settings.mantissa)


def compress(low: np.ndarray, mantissa: int) -> np.ndarray:
    """Leading zeros (6 bits) and the bits after the leading one of 64-bit minima."""
    top = np.frexp((low >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)  # bits used of the upper 53
    zeros = np.minimum(53 - top, 63 - mantissa)
    body = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - mantissa)
    return ((zeros.astype(np.uint64) << np.uint64(mantissa)) | body).astype(np.uint16)


def band_keys(registers: np.ndarray, settings: NearSettings) -> np.ndarray:
    """One 64-bit key per set and band."""
    shaped = registers.reshape(len(registers), settings.bands, settings.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64) + np.uint64(11), shaped.shape[:2]).copy()
    for r in range(settings.rows):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + shaped[:, :, r])
    return key


def estimated_similarity(same: np.ndarray, n: np.ndarray, m: np.ndarray, settings: NearSettings) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, less the collisions expected between unrelated sets of ``n`` and
    ``m`` members (the approximation of Yu and Weber, "HyperMinHash", 2017)."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.169919487159739 * settings.registers * 2.0**-settings.mantissa * 4 * ratio / (1 + ratio) ** 2
    return (same - chance) / (settings.registers - chance)


def _names(values: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """The two halves of every set's 128-bit name, 0 for sets without members."""
    live, names = np.diff(offsets) > 0, []
    for salt in (0x1234_5678_9ABC_DEF1, 0x0FED_CBA9_8765_4321):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(salt)), out=total[1:])
        names.append(pa.array(np.where(live, mix(total[offsets[1:]] - total[offsets[:-1]]), np.uint64(0)).view(np.int64)))
    return names


def _sketches(docs: DataFrame, settings: NearSettings) -> DataFrame:
    """Per row: ``doc_id, n_shingles``, the 128-bit name of its set (``s1, s2``) and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            values, offsets = shingle_sets(block.column("text"), settings.words)
            kept = registers_of(values, offsets, settings)
            packed = [kept[i].tobytes() for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.diff(offsets)), *_names(values, offsets), pa.array(packed, pa.binary())],
                ["doc_id", "n_shingles", "s1", "s2", "registers"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, s1 long, s2 long, registers binary"
    )


def _banded(nodes: DataFrame, settings: NearSettings) -> DataFrame:
    """``bucket, node``: one row per set and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16)
                keys = band_keys(table.reshape(batch.num_rows, settings.registers), settings)
                node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), settings.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "bucket long, node long")


def _estimated(pairs: DataFrame, nodes: DataFrame, settings: NearSettings) -> DataFrame:
    """Pairs whose estimate, within ``slack`` standard errors, and whose set sizes can reach the threshold, with what names
    their nodes (``x, y``)."""
    goal = settings.percent / 100
    least = goal - settings.slack * math.sqrt(goal * (1 - goal) / settings.registers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                    for c in ("ra", "rb")
                )
                n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
                guess = estimated_similarity((left == right).sum(axis=1), n, m, settings)
                keep = (guess >= least) & (100 * np.minimum(n, m) >= settings.percent * np.maximum(n, m))
                yield batch.select(["a", "b", "x", "y"]).filter(pa.array(keep))

    side = nodes.select("node", "n_shingles", "registers", F.struct(*NAME).alias("name"))
    name = side.schema["name"].dataType.simpleString()
    named = pairs.join(side.toDF("a", "na", "ra", "x"), "a").join(side.toDF("b", "nb", "rb", "y"), "b")
    return named.select("a", "b", "na", "nb", "ra", "rb", "x", "y").mapInArrow(run, f"a long, b long, x {name}, y {name}")


def _sets(docs: DataFrame, wanted: DataFrame, settings: NearSettings) -> DataFrame:
    """``node, members`` (sorted hashes, packed): one row per wanted node (``node, first, s1, s2``), with the set of that name,
    read from a row with the id ``first``. Only texts that pass a fixed-size filter of those ids leave Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            values, offsets = shingle_sets(block.column("text"), settings.words)
            packed = [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *_names(values, offsets), pa.array(packed, pa.binary())],
                ["first", "s1", "s2", "members"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = semi_filter(docs.filter("doc_id is not null").select("doc_id", "text"), "doc_id", wanted, "first")
    sets = texts.mapInArrow(run, f"first {kind}, s1 long, s2 long, members binary")
    found = sets.join(wanted, ["first", "s1", "s2"])
    return found.dropDuplicates(["first", "s1", "s2"]).select("node", "members")  # a node has one name: no shuffle of its own


def _shingles(sets: DataFrame) -> DataFrame:
    """``node, shingle``: one row per member of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                members = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("members")]
                for x in range(0, len(members), 64):
                    some = members[x : x + 64]
                    owner = np.repeat(np.arange(x, x + len(some)), [len(m) for m in some])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(pa.array(owner)), pa.array(np.concatenate(some))], ["node", "shingle"]
                    )

    return sets.mapInArrow(run, "node long, shingle long")


def _common(nodes: DataFrame, docs: DataFrame, settings: NearSettings) -> DataFrame:
    """``node, facts`` of nodes (``node, first, s1, s2``): the size of each node's set and, by ``PARTS`` parts of the hash space,
    how many of its members some other of the nodes has, too."""
    part = F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")
    held = stage(_shingles(_sets(docs, nodes, settings)), "held")
    single = held.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
    counted = held.select("node", part, F.lit(1).alias("n")).unionByName(single.select("node", part, F.lit(-1).alias("n")))
    common = counted.groupBy("node").agg(
        *[F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).cast("int").alias(f"p{k}") for k in range(PARTS)],
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("size"),
    )
    return common.select("node", F.struct("size", *[f"p{k}" for k in range(PARTS)]).alias("facts"))


def _can_reach(settings: NearSettings):
    """Two sets cannot reach the threshold if even all members they may share, part by part, are too few. ``low`` and
    ``high`` bound the counts of one or several sets."""

    def possible(x, low, high):
        shared = F.least(x["p0"], high["p0"]).cast("double")  # holds counts exactly, and takes less code than checked sums
        for k in range(1, PARTS):
            shared = shared + F.least(x[f"p{k}"], high[f"p{k}"])
        return (100 + settings.percent) * shared >= settings.percent * (x["size"] + low["size"])

    return possible


def _verified(pairs: DataFrame, docs: DataFrame, settings: NearSettings) -> DataFrame:
    """Those of the estimated pairs whose full shingle sets reach the threshold."""
    pairs = stage(pairs, "estimated")
    wanted = pairs.select(F.inline(F.array("x", "y"))).dropDuplicates(["first", "s1", "s2"])  # dealt as the join needs them

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                inside = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inside >= settings.percent * (len(x) + len(y) - inside))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    members = stage(_sets(docs, wanted, settings), "members")
    named = pairs.select("a", "b").join(members.toDF("a", "ma"), "a").join(members.toDF("b", "mb"), "b")
    return named.select("a", "b", "ma", "mb").mapInArrow(compare, "a long, b long")


def _nodes(live: DataFrame) -> DataFrame:
    """One row per different set, numbered in the order of its smallest id: ``node, first, s1, s2, n_shingles, registers``."""
    sets = live.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("first"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("registers").alias("registers")
    )
    numbered = sets.orderBy("first", "s1", "s2").withColumn("node", F.monotonically_increasing_id())
    return stage(numbered, "nodes")  # stored, so that the numbers hold


def _same_document(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (``a, b``) between the different sets of rows that share an id: the least of them with each other one."""
    name = F.struct("s1", "s2")
    several = live.groupBy("doc_id").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).filter("lo <> hi").select("doc_id")
    held = live.join(several, "doc_id", "left_semi").select("doc_id", "s1", "s2").distinct()
    held = held.join(nodes.select("node", "s1", "s2"), ["s1", "s2"])
    least = held.groupBy("doc_id").agg(F.min("node").alias("a"))
    return held.join(least, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, settings: NearSettings | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``; other columns ignored): ``doc_id, n_shingles, component_id, kept``.

    Documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100 are linked; ``component_id`` is the
    smallest ``doc_id`` reachable over links, ``kept`` is true for that document. Texts with equal sets are one item from the
    start, so copies cost one row each. Null, empty and wordless texts have no shingles and link with nothing. Rows that
    share a ``doc_id`` are one document that has the links of each of its texts; a row with a null id keeps a null
    ``component_id``, links with nothing and is kept. An empty table gives an empty table.
    """
    settings = settings or NearSettings()
    sketches = stage(_sketches(docs, settings), "sketches")
    live = sketches.filter("n_shingles > 0 and doc_id is not null")
    nodes = _nodes(live)
    buckets = stage(_banded(nodes, settings), "bands")
    found = link_buckets(
        buckets,
        lambda pairs: _verified(_estimated(pairs, nodes, settings), docs, settings),
        lambda open_nodes: _common(nodes.select(*NAME).join(open_nodes, "node", "left_semi"), docs, settings),
        _can_reach(settings),
        _same_document(live, nodes),
    )
    # numbers follow the ids, so a class's smallest node has its smallest id
    heads = nodes.select(F.col("node").alias("component"), F.col("first").alias("linked"))
    linked = found.join(heads, "component").select("node", "linked")
    named = nodes.select("node", "s1", "s2", "first").join(linked, "node", "left")
    classes = named.select("s1", "s2", F.coalesce("linked", "first").alias("linked"))
    joined = sketches.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("linked", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op2_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op2_hyperminhash": op2_hyperminhash}
SQL = {
    "op2_hyperminhash": r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM tokens
), members AS (SELECT doc_id, md5(unnest(s)) AS h FROM sets),
seldom AS (SELECT h FROM members GROUP BY h HAVING count(*) > 1),
hits AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM (SELECT * FROM members SEMI JOIN seldom USING (h)) a JOIN (SELECT * FROM members SEMI JOIN seldom USING (h)) b USING (h)
  WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM hits JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
class AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN class USING (doc_id)
"""
}
