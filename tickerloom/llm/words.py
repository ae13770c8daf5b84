"""Words and word shingles of many texts at once, as arrays of 64-bit hashes.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``; A-Z count as a-z. Hashes are exact up to collisions of 64
bits, which within one document or pair are out of reach of any corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_CODE[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PLAIN = _SPACE.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = True


class Cache(dict):
    """What a process has made once; it stays behind when functions travel."""

    def __reduce__(self):
        return Cache, ()


_POWERS = Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(n - 1, 1 << 16).bit_length()  # doubled as blocks ask for more
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column laid end to end, and offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each, so that working arrays stay small whatever the
    length of a text; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat_bytes(batch.column(column))
        cut = np.unique(np.searchsorted(offsets, np.arange(limit, offsets[-1] + limit, limit), side="left"))
        last = 0
        for end in [*cut[cut < batch.num_rows].tolist(), batch.num_rows]:
            if end > last:
                yield batch.slice(last, end - last)
                last = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and offsets of the texts into them. ``between`` marks the bytes that
    separate words; with ``PLAIN`` that is everything in ASCII but letters and digits."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | fresh[1:n]
    close = solid.copy()
    close[:-1] &= ~solid[1:] | fresh[1:n]
    first, last = np.flatnonzero(begin), np.flatnonzero(close)
    up, down = _powers(n)
    total = _CODE[data]
    total *= up
    np.cumsum(total, out=total)
    upto = total[last]
    upto[1:] -= total[first[1:] - 1]
    if len(first) and first[0]:
        upto[0] -= total[first[0] - 1]
    return mix(upto * down[first]), np.searchsorted(first, offsets).astype(np.int64)


_BYTE = mix(np.arange(300, 556, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _byte_totals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return total, down


def byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at every place."""
    total, down = _byte_totals(data)
    return mix((total[size:] - total[:-size]) * down[: len(total) - size])


def range_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int = BLOCK_BYTES // 2) -> np.ndarray:
    """Hashes of ranges that lie one after the other, made from about ``limit`` bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data) + limit, limit)))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        low = starts[x]
        total, down = _byte_totals(data[low : starts[y - 1] + sizes[y - 1]])
        at = starts[x:y] - low
        out[x:y] = mix((total[at + sizes[x:y]] - total[at]) * down[at])
    return out


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within each text, and offsets of the texts into them. A text with fewer words
    gives its whole sequence as one run, a text without words none."""
    counts = np.diff(offsets)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    start = np.repeat(offsets[:-1] - out[:-1], runs) + np.arange(out[-1])
    length = np.repeat(np.minimum(counts, size), runs)
    state = np.full(len(start), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
    for k in range(size):
        if counts.min() >= size:
            state = mix(state * np.uint64(0x2545F4914F6CDD1D) + words[start + k])
        else:
            live = length > k
            state[live] = mix(state[live] * np.uint64(0x2545F4914F6CDD1D) + words[start[live] + k])
    return state, out


def distinct_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    parts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        part = np.sort(values[a:b])
        parts.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if b > a else part)
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), out


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat_bytes(column)
    return distinct_sets(*shingles(*word_hashes(data, offsets), size))
