"""Repeated byte strings across documents by column-wise suffix sorting of many short texts.

Equal strings of ``length`` bytes hold the same smallest k-gram hash, so neighbouring windows that share it travel together as
one segment, and windows that can be equal meet in one bucket. There all segments are sorted at once, a column per
round: each round puts one more symbol in front of every segment's suffix and updates the Burrows-Wheeler transform and the
common prefixes of the collection in one sequential pass. Runs of suffixes with a common prefix of ``length`` are equal
strings; the smallest document of a run keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.filters import key_filter, passes, place_of
from tickerloom.llm.warc import filesystem
from tickerloom.llm.words import Cache, blocks, byte_grams, flat_bytes, mix, range_hashes
from tickerloom.workspace import fresh_path, stage

NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class RepeatSettings:
    """Strings of ``length`` bytes count, found through their ``gram``-byte pieces. ``filter_bits`` is the fixed size of the
    filter of pieces that occur in several documents, ``bucket_bytes`` the text a bucket stands for, ``collection`` the
    segments sorted together (more only where one piece has more)."""

    length: int = 50
    gram: int = 20
    filter_bits: int = 27
    bucket_bytes: int = 8 << 20
    collection: int = 16384

    @property
    def reach(self) -> int:
        """k-grams in a string, and the most windows of a segment."""
        return self.length - self.gram + 1


def column_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all texts in sorted order, as ``(text, suffix length, common prefix with the one before)``.

    ``data`` holds the texts' bytes, none longer than 254. All texts start as empty suffixes. In each round every text that
    has a symbol left gets the suffix that is one symbol longer: the symbol is put into the transform at the place of the
    text's last suffix, and a stable sort of the transform by symbol gives the new suffix's place. The transform and the
    common prefixes are rewritten once per round, in order, with the new entries put in. The prefix shared by two new
    neighbours is one more than the least value between their tails, which a table of minima over powers of two answers.
    """
    m = len(starts)
    transform, shared = np.zeros(m, np.uint8), np.zeros(m, np.uint8)
    codes = data.astype(np.int16) + 1
    alphabet = np.unique(codes)
    rank = np.zeros(258, np.uint8)
    rank[alphabet] = np.arange(1, len(alphabet) + 1)  # UTF-8 uses fewer than 255 byte values
    symbols = rank[codes]
    at, active = np.arange(m), np.arange(m)  # place of each active text's last suffix; kept in order of place
    for column in range(1, int(sizes.max(initial=0)) + 1):
        alive = sizes[active] >= column
        at, active = at[alive], active[alive]
        fresh = symbols[starts[active] + sizes[active] - column]
        transform[at] = fresh
        marked = np.zeros(len(transform), bool)
        marked[at] = True
        filled = np.flatnonzero(transform)
        tails = filled[np.argsort(transform[filled], kind="stable")]
        new = marked[tails]
        near = new.copy()
        near[1:] |= new[:-1]
        spots = np.flatnonzero(near)
        value = np.zeros(len(spots), np.uint8)
        inner = spots > 0
        left, right = tails[np.maximum(spots - 1, 0)], tails[spots]
        same = inner & (transform[left] == transform[right])
        if same.any():
            value[same] = 1 + _minima(shared, left[same] + 1, right[same])
        put = np.zeros(len(transform) + len(at), bool)
        put[m:] = new
        grown = np.zeros(len(put), np.uint8)
        grown[~put] = transform
        prefix = np.zeros(len(put), np.uint8)
        prefix[~put] = shared
        prefix[m + spots] = value
        transform, shared = grown, prefix
        active = active[np.argsort(fresh, kind="stable")]
        at = np.flatnonzero(put)
    filled = np.flatnonzero(transform)
    follows = np.zeros(len(transform), np.int64)
    follows[filled[np.argsort(transform[filled], kind="stable")]] = m + np.arange(len(filled))
    text, size = np.zeros(len(transform), np.int32), np.zeros(len(transform), np.uint8)
    place, owner = np.arange(m), np.arange(m)
    text[:m] = owner
    for column in range(1, int(sizes.max(initial=0)) + 1):
        keep = sizes[owner] >= column
        owner = owner[keep]
        place = follows[place[keep]]
        text[place], size[place] = owner, column
    return text, size, shared


def _minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values`` over each range ``first..last``, both included."""
    span = (last - first + 1).astype(np.float64)
    level = np.frexp(span)[1] - 1
    out, table, step = np.zeros(len(first), np.uint8), values, 0
    order = np.argsort(level.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    for k in range(len(cuts) - 1):
        if k:
            table = np.minimum(table[: -(1 << step)], table[1 << step :])
            step = k
        mine = order[cuts[k] : cuts[k + 1]]
        if len(mine):
            out[mine] = np.minimum(table[first[mine]], table[last[mine] - (1 << k) + 1])
    return out


def segments(data: np.ndarray, offsets: np.ndarray, settings: RepeatSettings) -> tuple[np.ndarray, ...]:
    """``(piece, text, start, end)`` of all segments: runs of windows with one smallest piece hash, at most ``reach`` windows
    each; ``start`` and ``end`` are places in ``data``."""
    n, length = len(data), settings.length
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, span, reach = byte_grams(data, settings.gram), 1, settings.reach
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if reach > span:
        low = np.minimum(low[: span - reach], low[reach - span :])
    valid = np.zeros(len(low) + 1, np.int8)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long] + sizes[long] - length + 1, -1)
    inside = np.cumsum(valid[:-1], dtype=np.int8) > 0
    begin = inside.copy()
    begin[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    begin[offsets[long]] = True
    first = np.flatnonzero(begin)
    ends = np.flatnonzero(inside & np.append(~inside[1:] | begin[1:], True)) + 1
    pieces = -(-(ends - first) // reach)
    if (pieces > 1).any():
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop = np.repeat(ends, pieces)
        first = np.repeat(first, pieces) + part * reach
        ends = np.minimum(first + reach, stop)
    text = np.searchsorted(offsets, first, side="right") - 1
    return mix(low[first]), text, first, ends + length - 1  # smallest hashes are small: mixed again, they spread evenly


def _with_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, text, hash, order``: a row is named by id and text, and ordered by id with null last."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), order.alias("order"))


def _several(docs: DataFrame, bits: int, settings: RepeatSettings) -> str:
    """Path of the filter of pieces that occur in documents with different ids: one slice per bucket, in the shared folder."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            piece, text, _, _ = segments(*flat_bytes(block.column("text")), settings)
            if not len(piece):
                continue
            order = block.column("order").to_numpy()
            piece, who = piece >> np.uint64(16), order[text]
            by = np.lexsort((who, piece))
            piece, who = piece[by], who[by]
            keep = np.concatenate(([True], (piece[1:] != piece[:-1]) | (who[1:] != who[:-1])))
            piece, who = piece[keep], who[keep]
            ids, index = np.unique(who, return_inverse=True)
            yield from _dealt(piece >> np.uint64(48 - bits), piece, index, ids)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bucket = [], None
        for batch in batches:
            for row in range(batch.num_rows):
                bucket = batch.column("bucket")[row].as_py()
                parts.append(_taken(batch, row))
        piece, who = np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts])
        by = np.argsort(piece, kind="stable")
        piece, who = piece[by], who[by]
        cut = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        several = piece[cut][np.minimum.reduceat(who, cut) < np.maximum.reduceat(who, cut)]
        width = settings.filter_bits - bits
        places = (several >> np.uint64(48 - settings.filter_bits)) & np.uint64((1 << width) - 1)
        slice_ = np.zeros(1 << width, bool)
        slice_[places.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([np.packbits(slice_, bitorder="little").tobytes()], pa.binary())],
            ["bucket", "slice"],
        )

    dealt = docs.select("text", "order").mapInArrow(emit, "bucket int, high binary, low binary, who binary, ids binary")
    path = fresh_path(docs.sparkSession, "several")
    dealt.groupBy("bucket").applyInArrow(gather, "bucket int, slice binary").write.parquet(path)
    return path


def _runs(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array and where each begins, with the array's end put last."""
    new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return bucket[new], np.append(new, len(bucket))


def _dealt(bucket: np.ndarray, piece: np.ndarray, index: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted 48-bit pieces with their documents, packed, one row per bucket that occurs, with the ids of its documents alone:
    16 bytes a piece at most, however many buckets there are."""
    names, cuts = _runs(bucket)
    rank = np.repeat(np.arange(len(names)), np.diff(cuts))
    held, local = np.unique(rank * len(ids) + index, return_inverse=True)
    firsts = np.searchsorted(held, np.arange(len(names) + 1) * len(ids))
    local, docs = local - firsts[rank], ids[held % len(ids)]
    high, low = (piece >> np.uint64(16)).astype(np.uint32), (piece & np.uint64(0xFFFF)).astype(np.uint16)
    rows = []
    for name, x, y, p, q in zip(names.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), firsts[:-1].tolist(), firsts[1:].tolist()):
        who = local[x:y].astype(np.uint16 if q - p <= 65535 else np.uint32)
        rows.append((name, high[x:y].tobytes(), low[x:y].tobytes(), who.tobytes(), docs[p:q].tobytes()))
    columns = [pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "high", "low", "who", "ids"])


def _taken(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    high, low, who, ids = (batch.column(c)[row].as_buffer() for c in ("high", "low", "who", "ids"))
    high, low, ids = np.frombuffer(high, np.uint32), np.frombuffer(low, np.uint16), np.frombuffer(ids, np.int64)
    who = np.frombuffer(who, np.uint16 if len(ids) <= 65535 else np.uint32)
    return (high.astype(np.uint64) << np.uint64(16)) | low, ids[who]


_FILTERS = Cache()


def _load_filter(path: str, bits: int, filter_bits: int) -> np.ndarray:
    """The packed filter, read once per worker; its size is fixed by the settings."""
    import pyarrow.dataset as ds

    if path not in _FILTERS:
        _FILTERS.clear()
        store, inside = filesystem(path)
        table = np.zeros((1 << filter_bits) // 8, np.uint8)
        width = (1 << (filter_bits - bits)) // 8
        for batch in ds.dataset(inside, filesystem=store, format="parquet").to_batches():
            for bucket, part in zip(batch.column("bucket").to_pylist(), batch.column("slice")):
                table[bucket * width : (bucket + 1) * width] = np.frombuffer(part.as_buffer(), np.uint8)
        _FILTERS[path] = table
    return _FILTERS[path]


def _candidates(docs: DataFrame, path: str, bits: int, settings: RepeatSettings) -> DataFrame:
    """Segments whose piece passes the filter, packed, one row per bucket and block of documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for block in blocks(batches):
            data, offsets = flat_bytes(block.column("text"))
            piece, text, start, end = segments(data, offsets, settings)
            table = _load_filter(path, bits, settings.filter_bits)
            spot = (piece >> np.uint64(64 - settings.filter_bits)).astype(np.int64)
            keep = (table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
            piece, text, start, end = piece[keep], text[keep], start[keep], end[keep]
            if not len(piece):
                continue
            by = np.argsort(piece, kind="stable")
            piece, text, start, end = piece[by], text[by], start[by], end[by]
            buckets, cuts = _runs(piece >> np.uint64(64 - bits))
            order, names = block.column("order").to_numpy(), block.column("hash").to_numpy()
            rows = []
            for bucket, x, y in zip(buckets.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                size = end[x:y] - start[x:y]
                where = np.repeat(start[x:y] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                docs_here, who = np.unique(text[x:y], return_inverse=True)
                packed = [
                    data[where].tobytes(), size.astype(np.uint8).tobytes(), piece[x:y].tobytes(),
                    (start[x:y] - offsets[text[x:y]]).astype(np.int64).tobytes(), who.astype(np.uint32).tobytes(),
                    order[docs_here].tobytes(), names[docs_here].tobytes(),
                ]
                rows.append((bucket, *(press.compress(p) for p in packed)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))],
                ["bucket", "bytes", "size", "piece", "start", "who", "order", "hash"],
            )

    return docs.select("text", "hash", "order").mapInArrow(
        emit, "bucket int, bytes binary, size binary, piece binary, start binary, who binary, order binary, hash binary"
    )


def owners(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each text, laid end to end, the smallest of ``first`` over all texts that hold the same string; and
    offsets of the texts into them."""
    windows = sizes - length + 1
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(windows, out=out[1:])
    text, size, shared = column_sort(data, starts, sizes)
    cut = np.flatnonzero(shared < length)
    least = np.minimum.reduceat(np.where(size >= length, first[text], NO_ID), cut)
    value = np.repeat(least, np.diff(np.append(cut, len(text))))
    full = size >= length
    result = np.zeros(out[-1], np.int64)
    result[out[text[full]] + sizes[text[full]] - size[full]] = value[full]
    return result, out


def covered(
    live: np.ndarray, kind: np.ndarray, out: np.ndarray, keeper: np.ndarray, limit: np.ndarray, most: int = 1 << 20
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows whose ``keeper`` is below the ``limit`` of their occurrence, as ``(occurrence, first, last)``, for some
    occurrences at a time. ``kind`` is an occurrence's segment, whose windows are ``out[kind]..out[kind + 1]``. About ``most``
    windows are laid out at once, however often a segment occurs."""
    sizes = (out[1:] - out[:-1])[kind[live]]
    upto = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(upto, np.arange(0, (upto[-1] if len(upto) else 0) + most, most), side="right"))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        some, count = live[x:y], sizes[x:y]
        base = np.cumsum(count) - count
        spot = np.repeat(out[kind[some]] - base, count) + np.arange(count.sum())
        flag = keeper[spot] < np.repeat(limit[some], count)
        firsts = np.zeros(len(flag), bool)
        firsts[base] = True
        opens = np.flatnonzero(flag & (firsts | np.concatenate(([True], ~flag[:-1]))))
        closes = np.flatnonzero(flag & np.concatenate((firsts[1:] | ~flag[1:], [True])))
        owner = np.searchsorted(base, opens, side="right") - 1
        yield some[owner], opens - base[owner], closes - base[owner]


def _removed(candidates: DataFrame, settings: RepeatSettings) -> DataFrame:
    """``order, hash, spans``: byte ranges (start and end, 64 bits each) to remove, one row per document and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        kinds = (np.uint8, np.uint8, np.uint64, np.int64, np.uint32, np.int64, np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in kinds]
        count = 0
        for batch in batches:
            for row in range(batch.num_rows):
                got = [np.frombuffer(unpress.decompress(batch.column(i + 1)[row].as_buffer()), k) for i, k in enumerate(kinds)]
                got[4] = got[4].astype(np.int64) + count
                count += len(got[5])
                for store, value in zip(parts, got):
                    store.append(value)
        if not count:
            return
        data, sizes, piece, start, who, order, names = (np.concatenate(parts.pop(0)) for _ in kinds)
        sizes = sizes.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        # equal segments are sorted once, for their smallest document
        named = range_hashes(data, starts, sizes) + mix(sizes.astype(np.uint64) + piece)
        by = np.lexsort((named, piece))
        new = np.concatenate(([True], (named[by][1:] != named[by][:-1]) | (piece[by][1:] != piece[by][:-1])))
        kind = np.empty(len(by), np.int64)
        kind[by] = np.cumsum(new) - 1
        head = by[np.flatnonzero(new)]
        first = np.minimum.reduceat(order[who][by], np.flatnonzero(new))
        windows = sizes[head] - settings.length + 1
        out = np.zeros(len(head) + 1, np.int64)
        np.cumsum(windows, out=out[1:])
        keeper = np.repeat(first, windows)
        # a piece with one kind of segment is sorted already; the others go through the construction, whole pieces at a time
        group = np.cumsum(np.concatenate(([True], piece[head][1:] != piece[head][:-1]))) - 1
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        edges = np.flatnonzero(np.concatenate(([True], group[several][1:] != group[several][:-1]))) if len(several) else []
        cuts = [0]
        for edge in list(edges[1:]) if len(several) else []:
            if edge - cuts[-1] >= settings.collection:
                cuts.append(int(edge))
        for x, y in zip(cuts, [*cuts[1:], len(several)]):
            chosen = several[x:y]
            if len(chosen):
                heads = head[chosen]
                size = sizes[heads]
                at = np.cumsum(size) - size
                where = np.repeat(starts[heads] - at, size) + np.arange(size.sum())
                least, inner = owners(data[where], at, size, first[chosen], settings.length)
                spot = np.repeat(out[chosen] - inner[:-1], np.diff(inner)) + np.arange(inner[-1])
                keeper[spot] = least
        # windows of every occurrence whose string starts in a smaller document, as ranges of bytes
        del data, starts, sizes, piece, named, by, new
        limit = order[who]
        live = np.flatnonzero(np.minimum.reduceat(keeper, out[:-1])[kind] < limit)
        found = list(covered(live, kind, out, keeper, limit))
        if not found:
            return
        owner, opens, closes = (np.concatenate(f) for f in zip(*found))
        a, b, doc = start[owner] + opens, start[owner] + closes + settings.length, who[owner]
        by = np.lexsort((a, doc))
        spans, doc = np.column_stack([a[by], b[by]]), doc[by]
        edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(doc)) if len(doc) else edges
        for k in range(0, len(edges), 20_000):
            x, y = edges[k : k + 20_000], ends[k : k + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[doc[x]]), pa.array(names[doc[x]]),
                 pa.array([_merge(spans[i:j]).tobytes() for i, j in zip(x.tolist(), y.tolist())], pa.binary())],
                ["order", "hash", "spans"],
            )

    return candidates.groupBy("bucket").applyInArrow(run, "order long, hash long, spans binary")


def _merge(spans: np.ndarray) -> np.ndarray:
    """Sorted ranges with overlapping and touching ones joined."""
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    cut = np.flatnonzero(new)
    return np.column_stack([spans[cut, 0], np.append(reach[cut[1:] - 1], reach[-1])])


def repeated_spans(docs: DataFrame, settings: RepeatSettings | None = None) -> DataFrame:
    """``order, hash, spans``: ranges of bytes to remove per document, as packed pieces; see :func:`drop_repeats`."""
    settings = settings or RepeatSettings()
    keyed = _with_keys(docs)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(5, int(np.ceil(np.log2(max(size / settings.bucket_bytes, 1))))), settings.filter_bits - 3)
    path = _several(keyed, bits, settings)
    return stage(_removed(_candidates(keyed, path, bits, settings), settings), "spans")


def drop_repeats(docs: DataFrame, settings: RepeatSettings | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``; other columns ignored): ``doc_id, n_bytes, n_removed, n_spans, kept``
    (binary, the bytes left).

    Texts are UTF-8 bytes, null is empty. Each byte covered by a string of ``length`` bytes that also starts in a document
    with a smaller ``doc_id`` is removed; overlaps count, strings are judged on the input and never cross
    documents. Rows without an id come after all others; rows that share an id do not remove each other's strings. Texts
    shorter than ``length`` stay whole, an empty table gives an empty table.
    """
    settings = settings or RepeatSettings()
    spans = repeated_spans(docs, settings)
    found = spans.groupBy("order", "hash").agg(F.collect_list("spans").alias("spans"))
    keyed = _with_keys(docs).withColumn("place", place_of("hash"))
    table = key_filter(spans.select("hash").distinct(), "hash")

    def touched(batches: Iterator[pa.RecordBatch], wanted: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(table, batch.column("place").to_numpy())
            yield batch.filter(pa.array(hit if wanted else ~hit))

    cut = keyed.mapInArrow(touched, keyed.schema).join(found, ["order", "hash"], "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column("text"), batch.column("spans")):
                data = text.as_py().encode() if text.is_valid else b""
                gone, runs, kept = 0, 0, data
                if parts.is_valid:
                    ranges = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in parts.as_py()])
                    ranges = _merge(ranges[np.argsort(ranges[:, 0], kind="stable")]).tolist()
                    edges = [0, *(x for r in ranges for x in r), len(data)]
                    kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    gone, runs = len(data) - len(kept), len(ranges)
                rows.append((len(data), gone, runs, kept))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c) for c in zip(*rows))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both steps in one worker, since a stage with two keeps two of them a core."""
        for batch in touched(batches, False):
            none = pa.nulls(batch.num_rows, pa.list_(pa.binary()))
            yield from remove(iter([batch.select(["doc_id", "text"]).append_column("spans", none)]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    whole = keyed.select("doc_id", "text", "place").mapInArrow(untouched, schema)
    return whole.unionByName(cut.mapInArrow(remove, schema))


def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    done = drop_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_repeats": op4_repeats}
SQL = {}
