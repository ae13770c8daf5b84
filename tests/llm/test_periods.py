import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import periods as P


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[k] == words[k + q] for k in range(len(words) - q)))


def brute_runs(words, min_length=6, min_periods=4):
    n, found = len(words), []
    for q in range(1, n):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            first = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k + q - first
            if length >= max(min_length, min_periods * q) and smallest_period(words[first : first + length]) == q:
                found.append((first, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_equal_brute_force(symbols):
    assert P.runs_of(symbols) == brute_runs(symbols)
    assert P.runs_of(symbols, 2, 2) == brute_runs(symbols, 2, 2)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 6), min_size=1, max_size=9), st.integers(1, 7)), max_size=6))
def test_regions_hold_every_run(parts):
    symbols = [s for part, times in parts for s in part * times]
    words = [b"w%d" % s for s in symbols]
    assert P.word_runs(words) == brute_runs(symbols)
    regions = P.run_regions(np.array(symbols, np.int64))
    for start, length, _ in brute_runs(symbols):
        assert any(b <= start and start + length <= e for b, e in regions)
    assert all(x[1] <= y[0] for x, y in zip(regions, regions[1:]))


def test_extensions_equal_walking():
    rng = random.Random(1)
    symbols = [rng.randint(0, 2) for _ in range(300)]
    both = P.Extensions(*P.SuffixTree(symbols).tour())
    one, other = np.array([(a, b) for a in range(0, 300, 7) for b in range(300) if a != b]).T
    walked = [next((k for k in range(300) if b + k >= 300 or a + k >= 300 or symbols[a + k] != symbols[b + k]), 300) for a, b in zip(one, other)]
    assert both.common(one, other).tolist() == walked


def test_tour_sorts_suffixes():
    rng = random.Random(2)
    for size in (0, 1, 5, 200):
        symbols = [rng.randint(0, 3) for _ in range(size)]
        tree = P.SuffixTree(symbols)
        assert tree.tour()[0] == sorted(range(size + 1), key=lambda k: symbols[k:])
        assert sorted(tree.tour(sort=False)[0]) == list(range(size + 1))


def test_long_sequences():
    assert P.runs_of([0] * 30_000) == [(0, 30_000, 1)]
    words = [b"x%d" % k for k in range(50_000)] + [b"a", b"b", b"c"] * 4_000 + [b"y%d" % k for k in range(50_000)]
    assert P.word_runs(words) == [(50_000, 12_000, 3)]
    assert P.run_regions(np.arange(100_000)) == []


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = P.op12_periodic_runs(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_runs > 0 for r in rows) > 5
    short = 0
    for r in rows:
        words = [w.decode() for w in planted(r.doc_id, (texts[r.doc_id] or "").encode().split())]
        if len(words) > 1200:
            continue
        short += 1
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert short > 100


def test_hostile_tables(spark):
    kinds = "doc_id string, text string, runs int, collapsed string, n_words string, best int"
    rows = [
        ("a", "la " * 10, 1, "c", "n", 2), ("a", "la " * 10, 1, "c", "n", 2), (None, None, None, None, None, None), ("b", "", 1, "c", "n", 2),
        ("c", " \t\n\x0b\x0c\r ", 1, "c", "n", 2), ("d", "é\xa0é x\x1cy x\x1cy x\x1cy x\x1cy", 1, "c", "n", 2), ("e", "w " * 20_000, 1, "c", "n", 2),
    ]
    got = {(r.doc_id, r.n_words): r for r in P.periodic_runs(spark.createDataFrame(rows, kinds)).collect()}
    assert [tuple(x) for x in got["a", 10].runs] == [(0, 10, 1)] and got["a", 10].collapsed == "la"
    assert got[None, 0].runs == got["b", 0].runs == got["c", 0].runs == [] and got["c", 0].collapsed == ""
    assert got["d", 5].runs == [] and got["d", 5].collapsed == "é\xa0é x\x1cy x\x1cy x\x1cy x\x1cy"
    assert [tuple(x) for x in got["e", 20_000].runs] == [(0, 20_000, 1)]
    assert P.periodic_runs(spark.createDataFrame([], kinds)).count() == 0


@pytest.mark.parametrize("doc_id, text, want", [(None, "a b", "a b"), (3, None, None), (3, "", "")])
def test_planting_leaves_the_rest(spark, doc_id, text, want):
    df = spark.createDataFrame([(doc_id, text)], "doc_id long, text string")
    assert df.select(P.planted(df.text, df.doc_id)).first()[0] == want
