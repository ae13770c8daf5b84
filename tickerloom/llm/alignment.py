"""Alignment of two tokenizers over a corpus.

The tokens of either side tile the bytes of a text, so an as-of merge by document finds for each token start the token of
the other side that covers it. The union of both directions is every overlapping pair; places where both sides end cut the
tokens into groups. How often two ids are linked in the whole corpus then tells the likely partners from the chance ones.

Texts are handled in blocks. A block keeps its distinct id pairs and, per document, which of them it holds how often; only
the distinct pairs of blocks are shuffled for the corpus-wide counts and come back to their block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.byte_pairs import PATTERN, encode_ordinary
from tickerloom.llm.words import Cache, blocks, flat_bytes
from tickerloom.workspace import stage

_TOKENIZERS = Cache()


@dataclass(frozen=True)
class AlignSettings:
    """``a``: JSON file of a byte-level byte-pair vocabulary, ``b``: a piece model with byte fallback; both must be readable
    on every executor. ``window_bytes``: text whose different parts are encoded together; ``block_bytes``: text aligned at
    once. A longer text is a window and a block of its own."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"
    window_bytes: int = 16 << 20
    block_bytes: int = 2 << 20


def _byte_signs() -> dict[str, int]:
    """The byte that each printable sign of a byte-level vocabulary stands for: printable Latin-1 signs stand for themselves,
    the other bytes in order for the signs from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level byte-pair vocabulary whose merges are numbered in their order, so that ids are ranks. It holds every
    single byte and only joins neighbours, so the tokens of a text always give back its bytes."""

    lossless = True

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        signs = _byte_signs()
        ranks = {bytes(signs[c] for c in token): n for token, n in model["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if any(model["vocab"]["".join(m)] != 256 + n for n, m in enumerate(merges)):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        if any(bytes([n]) not in ranks for n in range(256)):
            raise ValueError(f"{path}: a single byte has no token")
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            self.bytes[n] = token
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts that begin with the space before them."""
        plain, encoding = self.encoding.encode_ordinary, self.encoding
        return [plain(part) if len(part) < 5000 else encode_ordinary(encoding, part) for part in parts]


class Pieces:
    """A piece model that adds the space before a text itself."""

    lossless = False

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError(f"{path}: a piece goes on after a space, so texts cannot be cut there")
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(n) else name.replace("▁", " ").encode()
            for n, name in enumerate(names)
        ]
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode([part[1:] for part in parts], num_threads=1)


def tokenizer(kind: type, path: str):
    """One per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = kind(path)
    return _TOKENIZERS[path]


def cut_parts(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Space + text cut before every single space between two visible ASCII signs, and the number of the text of each part.

    No token of either side reaches over such a place: the byte-level pattern starts a match there, and no piece goes on
    after a space. Parts therefore encode as they do within their text, and each different part is encoded once a block.
    """
    data, offsets = flat_bytes(pc.binary_join_element_wise("", texts, " "))
    visible = (data > 32) & (data < 127)
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 32) & visible[:-2] & visible[2:]
    cut[offsets[:-1]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts, len(data)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))
    return parts.dictionary_encode(), np.searchsorted(offsets, starts, side="right") - 1


@dataclass
class Side:
    """Tokens of one side over a block: ids, text numbers, and first and end byte within the block."""

    ids: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _differ(lists, flat, sizes, wide, values: list[bytes], parts: list[str]) -> np.ndarray:
    """Parts whose joined tokens are not their bytes. All are compared as one string first, and looked at one by one only
    where that or a part's length differs."""
    total = np.append(0, np.cumsum(wide))
    ends = np.cumsum(sizes)
    made = (total[ends] - total[ends - sizes]).tolist()
    if b"".join(map(values.__getitem__, flat.tolist())) == "".join(parts).encode():
        if made == [len(part.encode()) for part in parts]:
            return np.zeros(len(parts), bool)
    return np.array([b"".join(map(values.__getitem__, ids)) != part.encode() for ids, part in zip(lists, parts)], bool)


class Window:
    """Many texts, each different part of them encoded once. Texts whose joined tokens differ from space + text are lost."""

    STEP = 10_000  # parts encoded at a time

    def __init__(self, texts: pa.Array, tokenizers):
        encoded, self.text = cut_parts(texts)
        self.codes = encoded.indices.to_numpy()
        parts, self.sides = encoded.dictionary, []
        lost = np.zeros(len(texts), bool)
        for t in tokenizers:
            flats, counts, wrong = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for at in range(0, len(parts), self.STEP):
                some = parts.slice(at, self.STEP).to_pylist()
                lists = t.encode(some)
                counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                flats.append(np.fromiter(chain.from_iterable(lists), np.int32, int(counts[-1].sum())))
                if not t.lossless:
                    wrong.append(_differ(lists, flats[-1], counts[-1], t.sizes[flats[-1]], t.bytes, some))
            sizes = np.concatenate(counts)
            self.sides.append((np.concatenate(flats), sizes, np.cumsum(sizes) - sizes, t.sizes))
            if not t.lossless and (bad := np.concatenate(wrong)).any():
                lost[self.text[bad[self.codes]]] = True
        if lost.any():
            keep = ~lost[self.text]
            self.codes, self.text = self.codes[keep], self.text[keep]

    def tokens(self, first: int, end: int) -> list[Side]:
        """Both sides of the texts from ``first`` to before ``end``, numbered from 0."""
        x, y = np.searchsorted(self.text, [first, end])
        codes, text = self.codes[x:y], self.text[x:y] - first
        found = []
        for flat, sizes, starts, wide in self.sides:
            counts = sizes[codes]
            ends = np.cumsum(counts)
            at = np.arange(ends[-1] if len(ends) else 0)
            at += np.repeat(starts[codes] - (ends - counts), counts)
            ids = flat[at]
            width = wide[ids]
            end_at = np.cumsum(width)
            found.append(Side(ids, np.repeat(text, counts), end_at - width, end_at))
        return found


def links(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all overlapping pairs: each start with the other side's covering token, in both directions; a pair
    with equal starts is found twice and kept once."""

    def covering(these: Side, those: Side) -> np.ndarray:
        starts = pd.DataFrame({"at": these.start, "text": these.text})
        covers = pd.DataFrame({"at": those.start, "text": those.text, "cover": np.arange(len(those.ids))})
        return pd.merge_asof(starts, covers, on="at", by="text")["cover"].to_numpy(np.int64)

    of_a, of_b = covering(a, b), covering(b, a)
    later = np.flatnonzero(b.start > a.start[of_b]) if len(b.ids) else np.zeros(0, np.int64)
    return np.concatenate([np.arange(len(a.ids)), of_b[later]]), np.concatenate([of_a, later])


def groups(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side that end a group: those whose end is one of the other side, too."""
    last = int(a.end[-1]) + 1 if len(a.end) else 0
    ends_a, ends_b = np.zeros(last, bool), np.zeros(last, bool)
    ends_a[a.end], ends_b[b.end] = True, True
    return ends_b[a.end], ends_a[b.end]


def _names(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the ids below ``size``, eight bytes each, and how many digits they have."""
    if ("names", size) not in _TOKENIZERS:
        if size > 10_000_000:
            raise ValueError("ids of more than seven digits")
        names = [str(n).encode() for n in range(size)]
        digits = np.frombuffer(b"".join(name.ljust(8) for name in names), np.uint64)
        _TOKENIZERS["names", size] = digits, np.fromiter(map(len, names), np.int64, size)
    return _TOKENIZERS["names", size]


def group_texts(a: Side, b: Side, close_a: np.ndarray, close_b: np.ndarray, n_texts: int, n_ids: int) -> list[bytes]:
    """Per text ``a1,a2|b1;a3|b2,b3``: ids of either side by group. ``close_a``, ``close_b`` mark the last token of each group."""
    digits, lengths = _names(n_ids)
    last_a, last_b = np.flatnonzero(close_a), np.flatnonzero(close_b)
    at_a = np.arange(len(a.ids)) + np.append(0, last_b + 1)[np.cumsum(close_a) - close_a]
    at_b = np.arange(len(b.ids)) + (last_a + 1)[np.cumsum(close_b) - close_b]
    total = len(at_a) + len(at_b)
    ids, sign = np.empty(total, np.int32), np.full(total, ord(","), np.uint8)
    ids[at_a], ids[at_b] = a.ids, b.ids
    sign[at_a[last_a]], sign[at_b[last_b]] = ord("|"), ord(";")
    sizes = lengths[ids]
    signs = digits[ids].view(np.uint8).reshape(total, 8)
    signs.reshape(-1)[np.arange(0, 8 * total, 8) + sizes] = sign
    flat = signs[np.arange(8) <= sizes[:, None]].tobytes()
    sizes += 1
    bytes_of = np.bincount(a.text, sizes[at_a], n_texts) + np.bincount(b.text, sizes[at_b], n_texts)
    ends = np.append(0, np.cumsum(bytes_of.astype(np.int64))).tolist()
    return [flat[x : max(x, y - 1)] for x, y in zip(ends, ends[1:])]


BLOCK = "block long, {ids}, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, " \
    "pairs array<long>, pair_links array<long>, held array<int>, held_pairs binary, held_links binary"


def live_texts(texts: pa.Array) -> np.ndarray:
    """Numbers of the texts that are neither null nor empty."""
    return np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))


def align_block(
    ids: pa.Array, live: np.ndarray, sides: list[Side], number: int, n_ids: tuple[int, int], digest: bool
) -> pa.RecordBatch:
    """One row for the rows with the given ids, of which the ``live`` ones have tokens."""
    a, b = sides
    close_a, close_b = groups(a, b)
    named = group_texts(a, b, close_a, close_b, len(live), max(n_ids))
    of_group = a.text[close_a]
    one, other = links(a, b)
    found, pairs = pd.factorize(a.ids[one].astype(np.int64) * n_ids[1] + b.ids[other])
    text = a.text[one]
    held = np.sort(text * max(1, len(pairs)) + found)
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(held)))
    held_text, held_pair = np.divmod(held[first], max(1, len(pairs)))

    def whole(counts: np.ndarray) -> list:
        out = np.zeros(len(ids), np.int64)
        out[live] = counts
        return [out]

    labels = [""] * len(ids)
    for k, name in zip(live.tolist(), named):
        labels[k] = (hashlib.sha256(name).hexdigest() if digest else name.decode()) if name else ""
    per = [whole(np.bincount(x, minlength=len(live))) for x in (a.text, b.text, of_group, text, held_text)]
    columns = {
        "block": pa.array([number], pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        **{n: pa.array(x, pa.list_(pa.int64())) for n, x in zip(("n_a", "n_b", "n_groups", "n_links"), per)},
        "groups": pa.array([labels], pa.list_(pa.string())),
        "pairs": pa.array([pairs], pa.list_(pa.int64())),
        "pair_links": pa.array([np.bincount(found, minlength=len(pairs))], pa.list_(pa.int64())),
        "held": pa.array([per[4][0].astype(np.int32)], pa.list_(pa.int32())),
        "held_pairs": pa.array([held_pair.astype(np.uint32).tobytes()], pa.binary()),
        "held_links": pa.array([times.astype(np.uint32).tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def aligned_blocks(docs: DataFrame, settings: AlignSettings = AlignSettings(), digest: bool = False) -> DataFrame:
    """Stored table of aligned blocks of ``docs`` (``doc_id, text``; other columns are not read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [tokenizer(ByteLevel, settings.a), tokenizer(Pieces, settings.b)]
        number = TaskContext.get().partitionId() << 32
        n_ids = tuple(len(t.bytes) for t in both)
        for window in blocks(batches, limit=settings.window_bytes):
            live = live_texts(window.column("text"))
            encoded = Window(window.column("text").take(pa.array(live)), both)
            first = 0
            for part in blocks(iter([window]), limit=settings.block_bytes):
                x, y = np.searchsorted(live, [first, first + part.num_rows])
                yield align_block(part.column("doc_id"), live[x:y] - first, encoded.tokens(x, y), number, n_ids, digest)
                number, first = number + 1, first + part.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = BLOCK.format(ids=f"ids array<{kind}>")
    return stage(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``pair, a, b, links, best``: how many links of the corpus hold an id pair, and whether no partner of its ``b`` has more.

    The best of each ``b`` is a table of at most ``size_b`` rows, one for each id of the second vocabulary.
    """
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select("p.pairs", "p.pair_links")
    counts = stage(pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_links").alias("links")), "pair_counts")
    split = counts.withColumns({"a": F.floor(F.col("pair") / size_b), "b": F.col("pair") % size_b})
    top = split.groupBy("b").agg(F.max("links").alias("top"))
    return split.join(F.broadcast(top), "b").select("pair", "a", "b", "links", (F.col("links") == F.col("top")).alias("best"))


def score_documents(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    Each block meets the counts of its own pairs and nothing else, so a task holds one block however common a pair is.
    """
    wanted = aligned.select(F.col("block").alias("owner"), F.posexplode("pairs").alias("at", "pair"))
    known = wanted.join(counts.select("pair", "links", "best"), "pair").select("owner", "at", "links", "best")
    kind = aligned.schema["ids"].dataType.elementType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def run(block: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs.column("at").to_numpy()
        links = np.zeros(len(at), np.int64)
        best = np.zeros(len(at), np.int64)
        links[at], best[at] = pairs.column("links").to_numpy(), pairs.column("best").to_numpy().astype(np.int64)
        row = {name: block.column(name)[0].values for name in ["ids", *numbers, "groups", "held"]}
        held = np.frombuffer(block.column("held_pairs")[0].as_py(), np.uint32)
        times = np.frombuffer(block.column("held_links")[0].as_py(), np.uint32).astype(np.int64)
        ends = np.cumsum(row["held"].to_numpy().astype(np.int64))

        def per_text(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values * times)])
            return total[ends] - total[np.append(0, ends[:-1])]

        made = [pa.array(per_text(best[held])), pa.array(per_text(links[held]))]
        columns = [row["ids"], *[row[n] for n in numbers], *made, row["groups"]]
        return pa.Table.from_arrays(columns, ["doc_id", *numbers, "n_best", "count_sum", "groups"])

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in [*numbers, "n_best", "count_sum"]) + ", groups string"
    return aligned.drop("pairs", "pair_links").groupBy("block").cogroup(known.groupBy("owner")).applyInArrow(run, schema)


def align_tokenizers(docs: DataFrame, settings: AlignSettings = AlignSettings(), digest: bool = False) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``; other columns are ignored): ``doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups``.

    ``groups`` names the ids of both sides by group, as ``a1,a2|b1;a3|b2,b3``; with ``digest`` it holds the SHA-256 of that
    text instead, which keeps the stored blocks small. Texts that are null, empty, or that a tokenizer does not give back byte
    by byte have zeros and an empty ``groups``. Repeated rows are rows of their own and their links count each time; ids
    may be null, repeated and of any type; pairs with equal counts are all best. An empty table gives an empty table. A long text is encoded whole;
    a block takes some 60 bytes of memory a byte.
    """
    aligned = aligned_blocks(docs, settings, digest)
    size_b = len(tokenizer(Pieces, settings.b).bytes)
    return score_documents(aligned, pair_counts(aligned, size_b))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return align_tokenizers(docs, digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op11_alignment": op11_alignment}
SQL = {}
