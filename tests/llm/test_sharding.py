import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tickerloom.llm import sharding as S


def spread(sizes, found, parts):
    totals = [0] * parts
    for size, part in zip(sizes, found):
        totals[part] += size
    return max(totals) - min(totals)


def plain_differencing(sizes, parts):
    """The textbook loop with lists, without a heap."""
    states = [[(0, ())] * (parts - 1) + [(s, (n,))] for n, s in enumerate(sizes)]
    order = list(range(len(sizes)))
    while len(states) > 1:
        ranked = sorted(range(len(states)), key=lambda k: (states[k][0][0] - states[k][-1][0], order[k]))
        one, other = states[ranked[0]], states[ranked[1]]
        joined = sorted(((x + y, m + n) for (x, m), (y, n) in zip(one, reversed(other))), key=lambda p: p[0])
        keep = order[ranked[0]]
        gone = set(ranked[:2])
        order = [o for k, o in enumerate(order) if k not in gone] + [keep]
        states = [s for k, s in enumerate(states) if k not in gone] + [joined]
    found = [0] * len(sizes)
    for part, (_, members) in enumerate(states[0] if states else []):
        for n in members:
            found[n] = part
    return found


def test_differencing_equals_the_textbook_loop():
    rng = random.Random(3)
    for parts in (1, 2, 3, 7):
        for _ in range(30):
            sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(0, 40))), reverse=True)
            got, want = S.difference(sizes, parts), plain_differencing(sizes, parts)
            assert spread(sizes, got, parts) == spread(sizes, want, parts) and len(got) == len(sizes)


def test_differencing_is_near_the_best():
    rng = random.Random(4)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 100) for _ in range(9)), reverse=True)
        best = min(spread(sizes, f, 2) for f in itertools.product(range(2), repeat=9))
        greedy, totals = [], [0, 0]
        for s in sizes:
            k = totals.index(min(totals))
            totals[k] += s
            greedy.append(k)
        assert best <= spread(sizes, S.difference(sizes, 2), 2) <= spread(sizes, greedy, 2) + 12
    assert spread([8, 7, 6, 5, 4], S.difference([8, 7, 6, 5, 4], 2), 2) == 2


def check(rows, docs, parts):
    """Whole rows, groups kept together, sizes and checksums right, slots without gaps."""
    want = Counter((i, len(t.encode()) + 1 if t is not None else 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(parts))
    by_id = defaultdict(set)
    for i, t in docs:
        by_id[i].add(t)
    places = defaultdict(set)
    for r in rows:
        if len(by_id[r.doc_id]) == 1:
            places[next(iter(by_id[r.doc_id]))].add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    totals = [0] * parts
    for r in rows:
        totals[r.shard] += r["size"]
    return totals


def test_groups_slots_and_balance(spark):
    rng = random.Random(5)
    docs = [(k, "x" * rng.randint(0, 900)) for k in range(1500)] + [(k, "copy" * 50) for k in range(1500, 2100)] + [(9000, None), (9001, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = S.shard_documents(table, 16).collect()
    totals = check(rows, docs, 16)
    # 600 copies of 201 bytes are one group, larger than a sixteenth of all; the rest is level
    rest = sorted(totals)[:-1]
    assert max(totals) == 600 * 201 and max(rest) - min(rest) <= 30
    again = S.shard_documents(table.repartition(7, "text"), 16).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


@pytest.mark.parametrize("bundles", [8, 64, 8192])
def test_few_bundles_still_level(spark, bundles):
    rng = random.Random(6)
    docs = [(k, f"{k} " + "y" * rng.randint(0, 400)) for k in range(4000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    totals = check(S.shard_documents(table, 4, bundles).collect(), docs, 4)
    assert max(totals) - min(totals) <= (sum(totals) / bundles if bundles < 100 else 2)
    places = S.place_groups(spark.createDataFrame([(k, 5) for k in range(1000)], "key long, bytes long"), 4, bundles)
    assert places.count() <= 2 * bundles


def test_hostile_tables(spark):
    kinds = "doc_id string, text string, shard int, key string, lane int, size string"
    rows = [("a", "t", 1, "k", 2, "s")] * 3 + [(None, "t", 1, None, 2, "s"), (None, None, None, None, None, None), ("b", "", 1, "k", 2, "s")]
    got = S.shard_documents(spark.createDataFrame(rows, kinds), 3).collect()
    check(got, [(r[0], r[1]) for r in rows], 3)
    assert len({r.shard for r in got if r["size"] == 2}) == 1
    assert S.shard_documents(spark.createDataFrame([], kinds), 3).count() == 0


def test_many_equal_rows_are_written_out(spark):
    docs = spark.range(25_000).selectExpr("1L as doc_id", "'same' as text")
    slots = [r.slot for r in S.shard_documents(docs, 4).collect()]
    assert sorted(slots) == list(range(25_000))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = S.op13_sharding(spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    totals = check(rows, docs, 16)
    sizes = Counter()
    for _, t in docs:
        sizes[t] += len(t.encode()) + 1
    plain = sorted(sizes.values(), reverse=True)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert max(totals) - min(totals) <= max(spread(plain, plain_differencing(plain, 16), 16) * 2, 64)
