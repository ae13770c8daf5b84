"""Benchmark decontamination by spaced seeds.

Fixed masks pick six of seven or eight neighbouring words and ignore the rest, so a hit survives substituted words. The hashes
under all masks are joined between benchmark and documents, and around each hit the texts are compared word by word on the
hit's diagonal: a window with few enough differences is an overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickerloom.llm.words import PLAIN, blocks, flat_bytes, mix, word_hashes

FILTER_BITS = 22


@dataclass(frozen=True)
class OverlapSettings:
    """Two texts overlap where ``window`` words in a row differ in at most ``substitutions``. Items with fewer words, down to
    ``least``, are compared whole with one substitution; shorter ones are left out, since a few common words prove nothing.
    With these masks every such overlap holds a hit, which a test shows by enumeration. ``part_words`` bounds the
    benchmark words a task holds at once."""

    masks: tuple[str, ...] = ("1011111", "1110111", "11111001")
    window: int = 13
    substitutions: int = 2
    least: int = 8
    part_words: int = 1_000_000


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask at every position that has room for it."""
    room = max(len(words) - len(mask) + 1, 0)
    total = np.full(room, len(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += words[k : k + room] * mix(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
    return mix(total)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and offsets of the texts into them."""
    return word_hashes(*flat_bytes(pc.utf8_lower(texts)), PLAIN)


class SeedIndex:
    """Sorted seed hashes of some benchmark items with their places, the items' words, and a bitmap to skip most lookups."""

    def __init__(self, items: list[tuple[int | None, str | None]], settings: OverlapSettings, times: list[int] | None = None):
        self.settings = settings
        self.ids = [i for i, _ in items]
        self.times = times or [1] * len(items)  # benchmark rows each item stands for
        words, at = plain_words(pa.array([t for _, t in items], pa.string()))
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:])]
        self.seeds = []
        for mask in settings.masks:
            parts = [(seed_hashes(w, mask), k) for k, w in enumerate(self.words) if len(w) >= settings.least]
            hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
            item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(h), k) for h, k in parts)])
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h, _ in parts)])
            order = np.argsort(hashes, kind="stable")
            known = np.zeros(1 << FILTER_BITS, bool)
            known[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.seeds.append((mask, hashes[order], item[order], place[order], known))

    def plain(self) -> dict:
        """The index as numbers and arrays alone, for a broadcast."""
        return {"ids": self.ids, "times": self.times, "words": self.words, "seeds": self.seeds}

    @classmethod
    def of(cls, plain: dict, settings: OverlapSettings) -> SeedIndex:
        index = cls.__new__(cls)
        index.__dict__.update(plain, settings=settings)
        return index

    def overlaps(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, first word, end word, equal words)`` of every text and item that overlap; the texts' words lie end to
        end, with offsets ``at``. Of several overlaps of a pair the extent covers all."""
        diagonals: list[np.ndarray] = []
        for mask, hashes, item, place, known in self.seeds:
            found = seed_hashes(words, mask)
            spots = np.flatnonzero(known[found >> np.uint64(64 - FILTER_BITS)])
            low, high = (np.searchsorted(hashes, found[spots], side) for side in ("left", "right"))
            times = high - low
            spots, low, times = spots[times > 0], low[times > 0], times[times > 0]
            if len(spots):
                which = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                spot = np.repeat(spots, times)
                text = np.searchsorted(at, spot, side="right") - 1
                inside = spot + len(mask) <= at[text + 1]
                diagonals.append(np.column_stack([text, item[which], spot - place[which]])[inside])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, shift in np.unique(np.concatenate(diagonals), axis=0).tolist() if diagonals else []:
            span = self._compare(words, int(at[text]), int(at[text + 1]), self.words[item], shift)
            if span:
                old = best.get((text, item))
                if old:
                    span = (min(old[0], span[0]), max(old[1], span[1]), max(old[2], span[2]))
                best[text, item] = span
        return [(*key, *span) for key, span in sorted(best.items())]

    def _compare(self, words, start: int, end: int, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        """Extent in the text, counted from its start, and equal words of all windows on one diagonal that overlap."""
        width = min(self.settings.window, len(item))
        allowed = self.settings.substitutions if len(item) >= self.settings.window else min(1, self.settings.substitutions)
        first, last = max(0, start - shift), min(len(item), end - shift)
        if last - first < width:
            return None
        same = (item[first:last] == words[shift + first : shift + last]).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(total[width:] - total[:-width] >= width - allowed)
        if not len(good):
            return None
        a, b = int(good[0]), int(good[-1]) + width
        return shift + first + a - start, shift + first + b - start, int(total[b] - total[a])


def seed_indexes(benchmark: DataFrame, settings: OverlapSettings) -> Iterator[SeedIndex]:
    """Indexes over disjoint parts of ``benchmark`` (``item_id, text``), each of about ``part_words`` words: a stated query set
    that is compared with all documents in blocks. What a task holds is bounded however large the benchmark is; equal rows are
    one item with a count."""
    items = benchmark.filter("text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = -(-words // settings.part_words)
    for part in range(parts):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = sorted(((r["item_id"], r["text"], r["times"]) for r in chosen.collect()), key=str)  # about part_words words
        yield SeedIndex([row[:2] for row in rows], settings, [row[2] for row in rows])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, settings: OverlapSettings | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``) and benchmark item (``item_id, text``) that overlap: ``doc_id, item_id,
    first_word, end_word, n_equal, similarity``.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower case. ``first_word`` and ``end_word``
    bound the overlap in the document, ``similarity`` is the share of equal words in it. Null and empty texts overlap with
    nothing, ids may be null or repeated (each row counts), an empty table on either side gives no rows; other
    columns are ignored.
    """
    settings = settings or OverlapSettings()
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, end_word long, n_equal long, similarity double"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in seed_indexes(benchmark, settings):
        held = docs.sparkSession.sparkContext.broadcast(index.plain())

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = SeedIndex.of(held.value, settings)
            for block in blocks(batches):
                words, at = plain_words(block.column("text"))
                rows = index.overlaps(words, at)
                if rows:
                    text, item, first, end, equal = (np.array(c) for c in zip(*rows))
                    ids = pa.array([index.ids[i] for i in item], item_type)
                    yield pa.RecordBatch.from_arrays(
                        [block.column("doc_id").take(pa.array(text)), ids, pa.array(first), pa.array(end), pa.array(equal),
                         pa.array(equal / (end - first)), pa.array([index.times[i] for i in item], pa.int64())],
                        ["doc_id", "item_id", "first_word", "end_word", "n_equal", "similarity", "times"],
                    )

        hits = docs.select("doc_id", "text").mapInArrow(run, schema + ", times long")
        found = found.unionByName(hits.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times"))
    return found


def drop_overlapping(docs: DataFrame, benchmark: DataFrame, settings: OverlapSettings | None = None) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, all columns unchanged, without a shuffle."""
    settings = settings or OverlapSettings()
    for index in seed_indexes(benchmark, settings):
        held = docs.sparkSession.sparkContext.broadcast(index.plain())

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = SeedIndex.of(held.value, settings)
            for block in blocks(batches):
                words, at = plain_words(block.column("text"))
                clean = np.ones(block.num_rows, bool)
                clean[[row[0] for row in index.overlaps(words, at)]] = False
                yield block.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the benchmark items they overlap with."""
    return find_overlaps(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    )


QUERIES = {"op1_spaced_seeds": op1_spaced_seeds}
SQL = {}
