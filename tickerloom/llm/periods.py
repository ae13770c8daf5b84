"""Runs: stretches of words that repeat with a period, and texts with the repeats taken out.

A run is a maximal stretch of words that is periodic with its smallest period. Every run holds a Lyndon root: under one of the
two orders of the words, the longest Lyndon word that starts at some place is its period. That word ends where the next
smaller suffix starts, so each place gives one candidate per order, and common extensions to both sides of its two ends show
how far it repeats. Extensions come from suffix trees of the words and of their reversal, built by Ukkonen's algorithm: the
string depth of the lowest common ancestor of two leaves, read in constant time as a minimum over the Euler tour.

Trees are made of the parts of a document that can hold a run at all (see ``run_regions``); most documents have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.words import blocks

WORD = r"[^\x20\x09-\x0D]+"
MIN_LENGTH, MIN_PERIODS = 6, 4
BLOCK_BYTES = 2 << 20


class SuffixTree:
    """Suffix tree of a sequence of non-negative numbers, closed by a sign of its own that is smaller than all of them.

    Inner nodes are numbered from 0, the leaf of suffix ``k`` is ``~k``; ``kids`` are the children of inner nodes by sign and
    ``depth`` their string depths.
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, -1]
        start, end, link, depth, kids = [0], [0], [0], [0], [{}]
        leaves: list[int] = []  # where the edge to each leaf begins; it goes on to the end
        node = edge = length = pending = 0
        for at, sign in enumerate(text):
            pending += 1
            unlinked = 0
            while pending:
                if not length:
                    edge = at
                below = kids[node]
                child = below.get(text[edge])
                if child is None:
                    below[text[edge]] = ~len(leaves)
                    grown = 0
                    if unlinked:
                        link[unlinked] = node
                else:
                    if child < 0:
                        begin = leaves[~child]
                    else:
                        begin = start[child]
                        width = end[child] - begin
                        if length >= width:  # walk down
                            edge += width
                            length -= width
                            node = child
                            continue
                    if text[begin + length] == sign:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    grown = len(start)
                    below[text[edge]] = grown
                    start.append(begin)
                    end.append(begin + length)
                    link.append(0)
                    depth.append(depth[node] + length)
                    begin += length
                    kids.append({text[begin]: child, sign: ~len(leaves)})
                    if child < 0:
                        leaves[~child] = begin
                    else:
                        start[child] = begin
                    if unlinked:
                        link[unlinked] = grown
                leaves.append(at)
                unlinked = grown
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - pending + 1
        self.kids, self.depth = kids, depth

    def tour(self, sort: bool = True) -> tuple[list[int], list[int]]:
        """Suffixes in the order of an Euler tour, and between each two of them the string depth of the topmost node the tour
        passes there, which is their lowest common ancestor. Sorted, children go by their first sign, so suffixes do, too."""
        kids, depth = self.kids, self.depth
        order, between, nodes, above = [], [], [0], [0]
        while nodes:
            node, common = nodes.pop(), above.pop()
            if node < 0:
                order.append(~node)
                between.append(common)
                continue
            below = kids[node]
            nodes += [below[sign] for sign in sorted(below, reverse=True)] if sort else below.values()
            above += [depth[node]] * (len(below) - 1)
            above.append(common)
        return order, between[1:]


class Extensions:
    """Longest common prefix of any two suffixes: the smallest depth on the tour between their leaves, from a table of minima
    over powers of two."""

    def __init__(self, order: list[int], between: list[int]):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [np.array(between, np.int32)]
        width = 1
        while 2 * width <= len(between):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For different suffixes only."""
        a, b = self.rank[one], self.rank[other]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.table[k]
            found[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return found


def next_smaller(rank: list[int]) -> list[int]:
    """Per place the next one with a smaller rank, or the end."""
    n = len(rank)
    found, stack = [n] * n, []
    for at in range(n - 1, -1, -1):
        value = rank[at]
        while stack and rank[stack[-1]] > value:
            stack.pop()
        if stack:
            found[at] = stack[-1]
        stack.append(at)
    return found


def runs_of(symbols: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs with ``length >= max(min_length, min_periods * period)``, sorted by start and
    period; ``min_periods`` is at least 2.

    A place's longest Lyndon word ends where the next smaller suffix starts, under the reversed order where the next larger
    one does. A run that a smaller word ends, or the end of the text, shows under the order, one that a larger word ends
    under the reversed order.
    """
    n = len(symbols)
    if n < min_length:
        return []
    ahead = Extensions(*SuffixTree(symbols).tour())
    behind = Extensions(*SuffixTree(symbols[::-1]).tour(sort=False))
    found = []
    for rank in (ahead.rank[:n], -ahead.rank[:n]):
        ends = np.array(next_smaller(rank.tolist()))
        first = np.flatnonzero(ends < n)
        then = ends[first]
        right = ahead.common(first, then)
        left = np.zeros(len(first), np.int64)
        inner = np.flatnonzero(first > 0)
        left[inner] = behind.common(n - first[inner], n - then[inner])
        period = then - first
        length = period + left + right
        good = (length >= min_length) & (length >= min_periods * period)
        found.append(np.column_stack([first - left, period, length])[good])
    merged = np.unique(np.concatenate(found), axis=0)
    return [(start, length, period) for start, period, length in merged.tolist()]


def run_regions(
    codes: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS
) -> list[tuple[int, int]]:
    """Disjoint ranges of words, each run lying whole in one of them.

    In a run of period q, every word after the first q stands at most q words after its last occurrence. So those words, at
    least ``max(min_length - q, (min_periods - 1) * q)``, lie in one stretch of words with such short distances, and the run
    begins at most q words before that stretch. Periods are looked at in ranges from a power of two to the next; ranges that
    overlap are merged, so a run found in one cannot go on outside. ``codes`` may be hashes: words taken for equal only add to
    the ranges.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    distance = np.full(n, n + 1)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    spans = []
    low = 1
    while low * min_periods <= n:
        high = 2 * low - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], distance <= high, [False]])))
        begin, end = edge[::2], edge[1::2]
        wide = end - begin >= max(min_length - high, (min_periods - 1) * low)
        spans += zip(np.maximum(begin[wide] - high, 0).tolist(), end[wide].tolist())
        low *= 2
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if merged and begin < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((begin, end))
    return merged


def word_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """All runs of a sequence of words."""
    if len(words) < max(min_length, min_periods):
        return []
    found = []
    for begin, end in run_regions(np.fromiter(map(hash, words), np.int64, len(words)), min_length, min_periods):
        numbers: dict[bytes, int] = {}
        symbols = [numbers.setdefault(word, len(numbers)) for word in words[begin:end]]
        found += [(begin + start, length, period) for start, length, period in runs_of(symbols, min_length, min_periods)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(keep).tolist())


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``; other columns are ignored): ``doc_id, n_words, runs, collapsed``.

    Words are runs of bytes other than space and ``\\t\\n\\v\\f\\r``, compared byte by byte. ``runs`` are structs ``start,
    length, period`` in words, by start and period; ``collapsed`` is the text without the words that a run repeats, joined by
    single spaces. Null and empty texts have no words, no runs and an empty ``collapsed``; ids may be null, repeated and of any
    type; an empty table gives an empty table. Texts are looked at whole and one by one, without a shuffle; trees take
    about 1 KB of memory per word of a region, so a region of a million words takes about 1 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=BLOCK_BYTES):
            counts, found, left = [], [], []
            for text in part.column("text"):
                words = text.as_py().split() if text.is_valid else []
                runs = word_runs(words, min_length, min_periods)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                left.append(collapsed(words, runs).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, RUNS), pa.array(left, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    bytes_of = F.col("text").cast("string").cast("binary").alias("text")
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", bytes_of).mapInArrow(run, schema)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def planted(text: Column, doc_id: Column) -> Column:
    """The text of every tenth document or so with its tail made periodic: with h the CRC of the id in decimal and g = h div
    10, words from ``a = g mod n`` on repeat the first ``1 + (n - a) div (3 + g mod 8)`` of them. A null id leaves the text."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def repeated(one: Column) -> Column:
        w, n = one["w"], F.size(one["w"]).cast("long")
        a = one["g"] % n
        p = F.floor((n - a) / (F.lit(3) + one["g"] % 8)) + 1
        # whole copies of the period, the last one cut; no expression over the words stands inside a loop over them
        copies = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(copies, F.lit(1), (n - a).cast("int"))), " ")

    # a one-element array binds the words, so that they are taken from the text once
    tail = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda one: F.when(F.size(one["w"]) > 0, repeated(one)))
    return F.when(h % 10 == 0, F.coalesce(F.get(tail, F.lit(0)), text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("shrink"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shrink")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.shrink")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL = {}
