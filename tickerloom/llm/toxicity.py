"""Toxicity by a weighted lexicon.

Texts are folded first: case, homoglyphs of Latin letters, digits and signs that stand for letters. A lexicon of word stems
and words, weighted by how much likelier they make the toxic label, is matched with an Aho-Corasick automaton; matches inside
exception phrases do not count. The weight found, as such and by length, goes through a logistic function.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tickerloom.workspace import stage

# Letters of other scripts that look like Latin ones, and digits and signs used in their place.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ո": "n", "օ": "o", "ս": "u",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"
#: Harmless phrases with words that are often in toxic lexicons.
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "class clown", "clown fish", "pathetic fallacy", "pond scum")


@dataclass(frozen=True)
class ToxicitySettings:
    """``sample`` bounds the labelled rows a lexicon is learned from (about, as they are picked by hash), ``terms`` its size. A term is a word or a word's first
    ``stems`` letters, found in at least ``support`` toxic rows and with log odds of at least ``least``."""

    sample: int = 40_000
    terms: int = 5_000
    support: int = 4
    least: float = 3.5
    stems: tuple[int, ...] = (3, 4, 5, 6)
    exceptions: tuple[str, ...] = EXCEPTIONS


class _Fold(dict):
    """Translation table: letters as folded, anything that ends a word a space, invisible characters nothing."""

    def __missing__(self, code: int) -> int | str | None:
        char = chr(code)
        if 0xFF01 <= code <= 0xFF5E:  # full-width forms
            out = self[code - 0xFEE0]
        else:
            low = char.lower()
            low = HOMOGLYPHS.get(low, DIGITS.get(low, low))
            out = low if low.isalnum() or (len(low) > 1) else " "
        self[code] = out
        return out


_FOLD = _Fold({ord(c): None for c in INVISIBLE} | {ord("'"): "'"})


def fold(text: str) -> str:
    """Folded text with one space before and after."""
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    """``weights`` by term (a term starts with a space; one that also ends with a space is a whole word), ``exceptions`` and
    the three coefficients of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slopes: tuple[float, float] = (1.0, 1.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}  # automata are built once per worker

    def machine(self):
        import ahocorasick

        if self._machine is None:
            machine = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                machine.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                machine.add_word(fold(phrase), (len(fold(phrase)), None))
            if len(machine):
                machine.make_automaton()
            self._machine = machine
        return self._machine

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight found, and weight found per square root of 100 words. Of terms that start at one word the heaviest counts,
        and a word that occurs n times counts 1 + ln n times."""
        machine = self.machine()
        if not text or not len(machine):
            return 0.0, 0.0
        folded = fold(text)
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in machine.iter(folded):
            start = end - length + 1
            if weight is None:
                excused.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for a, b in excused:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        words = Counter(folded[s + 1 : folded.index(" ", s + 1)] for s in found)
        weights = {folded[s + 1 : folded.index(" ", s + 1)]: weight for s, weight in found.items()}
        total = sum(weights[w] * (1.0 + math.log(n)) for w, n in words.items())
        return math.log1p(total), total / math.sqrt(1 + folded.count(" ") / 100)

    def score(self, texts: list[str | None]) -> np.ndarray:
        table = np.array([self.features(t) for t in texts], float).reshape(-1, 2)
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + table @ np.array(self.slopes), -30, 30)))


def terms_of(text: str, stems: tuple[int, ...]) -> set[str]:
    words = {w for w in fold(text).split() if len(w) <= 40}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in stems if len(w) > n}


def _counted(rows: DataFrame, settings: ToxicitySettings) -> DataFrame:
    """Toxic and other rows each term occurs in; tasks add up their own rows before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            keys = list(set(counts[0]) | set(counts[1]))
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([counts[1][k] for k in keys]), pa.array([counts[0][k] for k in keys])],
                ["term", "toxic", "other"],
            )
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                counts[toxic].update(terms_of(text.as_py(), settings.stems))
                if len(counts[0]) > 400_000:
                    yield flush()
        if counts[0] or counts[1]:
            yield flush()

    parts = rows.select("text", "toxic").mapInArrow(run, "term string, toxic long, other long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(rows: DataFrame, settings: ToxicitySettings | None = None) -> Lexicon:
    """Lexicon from labelled ``rows`` (``text, toxic`` 0/1; null texts and labels are left out), which the caller bounds as
    :func:`training_rows` does.

    Terms are weighted by smoothed log odds; a longer term stays only where it says more than its stem. The logistic
    coefficients are fitted on the same rows. With one label only, or no rows, the lexicon is empty and every score is low.
    """
    settings = settings or ToxicitySettings()
    usable = rows.filter("text is not null and toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    picked = stage(usable, "labelled")
    totals = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({}, settings.exceptions)
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("other") + 0.5) / (good + 1.0))
    strong = _counted(picked, settings).filter(F.col("toxic") >= settings.support).withColumn("odds", odds)
    strong = strong.filter(F.col("odds") >= settings.least).orderBy(F.desc("toxic"), F.desc("odds"), "term").limit(settings.terms)
    weights: dict[str, float] = {}
    for row in sorted(strong.collect(), key=lambda r: (len(r["term"]), r["term"])):  # at most settings.terms rows
        term, weight = row["term"], row["odds"]
        if not any(weights.get(term[:n], -1) >= weight - 1.0 for n in range(2, len(term))):
            weights[term] = weight
    lexicon = Lexicon(weights, settings.exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([lexicon.features(t.as_py()) for t in batch.column("text")], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(table[:, 0]), pa.array(table[:, 1])], ["toxic", "x0", "x1"]
            )

    found = picked.mapInArrow(run, "toxic int, x0 double, x1 double").collect()  # as many as the sample
    table = np.array(sorted(map(tuple, found)), float)  # in one order, so that reruns agree to the last bit
    lexicon.bias, lexicon.slopes = _logistic(table[:, 1:], table[:, 0])
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Bias and slopes by damped Newton steps with a small ridge."""
    full = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2]) * len(x) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), (float(beta[1]), float(beta[2]))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the toxicity of the whole ``text`` from 0 to 1. Null and empty texts score as texts
    without matches; every other column is passed through, and one called ``name`` is replaced."""
    columns = [f for f in docs.schema.fields if f.name != name]
    place = next(i for i, f in enumerate(columns) if f.name == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = lexicon.score([t.as_py() for t in batch.column(place)]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    kept = docs.select(*[F.col(f"`{f.name}`") for f in columns])
    return kept.mapInArrow(run, StructType([*columns]).add(name, DoubleType()))


def held_out(doc_id: Column) -> Column:
    """Rows set aside for judging: remainder 0 of the checksum of the id as text by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings | None = None) -> DataFrame:
    """Labelled texts that are not held out, ``text, toxic``; ids with several labels count once per label, and of rows that
    share an id the least text is taken.

    If there are more than ``settings.sample`` labels, about that many are taken by the hash of their id. The bound makes
    the labels small enough to broadcast, so that texts are not shuffled.
    """
    settings = settings or ToxicitySettings()
    usable = labels.filter(~held_out(F.col("doc_id"))).filter("toxic is not null").select("doc_id", "toxic").distinct()
    share = min(1.0, settings.sample / max(usable.count(), 1))
    rows = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    labelled = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = learn_lexicon(training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    scored = score_toxicity(docs.select("doc_id", "text"), lexicon).select("doc_id", "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op8_toxicity": op8_toxicity}
SQL = {}
