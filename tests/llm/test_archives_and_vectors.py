"""Archives, nearest neighbours, running totals and the pipeline on small tables."""

import base64
import hashlib
import io
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_text_operators import docs_of, overlap_words, shingle_set

import corpus_pipeline
from tickerloom.llm import decontamination, neighbours, warc
from tickerloom.workspace import fresh_path

PAGES = "page_id long, url string, html string, payload string, ordinal int, name string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def test_archives_round_trip(spark):
    rng = random.Random(1)
    pages = ["".join(rng.choice("<p>é\r\n ab") for _ in range(rng.randrange(300))) for _ in range(60)]
    rows = [(k, f"http://h/{k}", pages[k % 45]) for k in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: y", ""), (102, "u", None), (103, "big", "z" * 3_000_000), (104, "big", "z" * 3_000_000)]
    rows += [(7, "again", pages[7]), (None, "n", "only here"), (None, "n", pages[3])]
    folder = fresh_path(spark, "archives")
    manifest = warc.write_archives(pages_of(spark, rows), folder, archive_bytes=4000)
    records = warc.read_archives(manifest, folder, payloads=True).collect()
    assert len(records) == len(rows) == manifest.agg(F.sum("records")).first()[0]
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in records) == sorted(
        (str(k), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for k, _, h in rows
    )
    by_payload = {}
    for k, _, h in rows:
        by_payload.setdefault(h or "", []).append(k)
    kept = {r.record_id: r for r in records if r.record_type == "response"}
    assert len(kept) == len(by_payload)
    for r in records:
        if r.record_type == "response":
            assert len(r.payload) == r.payload_bytes
            ids = [k for k in by_payload[bytes(r.payload).decode()] if k is not None]
            assert r.page_id == (min(ids) if ids else None) and r.refers_to is None
        else:
            assert not r.payload and kept[r.refers_to].payload_digest == r.payload_digest
    large = warc.write_archives(pages_of(spark, rows), folder, min_bytes=10**6)
    types = [r.record_type for r in warc.read_archives(large, folder).collect()]
    assert types.count("revisit") == 1
    assert warc.write_archives(pages_of(spark, []).limit(0), folder).count() == 0


def archive(records, dictionary=b""):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(dict_data=known)
    head = (0x184D2A5D).to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    return head + b"".join(press.compress(r) for r in records)


def test_reader_takes_frames_across_chunks_and_refuses_damage():
    records = [warc.record_bytes(k, 0, "u", f"<p>page {k} common text</p>".encode() * 20, None) for k in range(40)]
    data = archive(records, zstandard.train_dictionary(2000, records).as_bytes())
    for chunk in (1, 7, 1000, 1 << 20):
        assert list(warc.read_archive(io.BytesIO(data), chunk)) == records
    assert [warc.parse_record(r)["record_id"] for r in records] == [f"<urn:page:{k}:0>" for k in range(40)]
    for broken in (data[:-3], data[4:], data[:100], b"", archive(records) + b"junk"):
        with pytest.raises((warc.InvalidRecord, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(broken)))
    good = records[0]
    for bad in (
        good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"common", b"c0mmon"),
        good.replace(b"WARC-Type: response\r\n", b""), re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", rb"Content-Length: 5\r\n\r\nHTTP", good),
    ):
        with pytest.raises(warc.InvalidRecord):
            warc.parse_record(bad)


def test_neighbours_reach_recall_and_rules(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 24))
    vectors[100:140] = vectors[100]
    vectors[200:300] = vectors[7] + 0.1 * rng.normal(size=(100, 24))
    rows = [(k, [float(np.float32(x)) for x in v], 1, 0.0, 2) for k, v in enumerate(vectors)]
    rows += [(None, rows[0][1], 1, 0.0, 2), (2000, None, 1, 0.0, 2), (2001, [0.0] * 24, 1, 0.0, 2), (2002, [float("nan")] + [1.0] * 23, 1, 0.0, 2)]
    rows += [(2003, [None] + [1.0] * 23, 1, 0.0, 2), (2050, [float("inf")] + [1.0] * 23, 1, 0.0, 2), (2100, [1.0, 2.0], 1, 0.0, 2), (2101, [2.0, 1.0], 1, 0.0, 2), (3, rows[3][1], 1, 0.0, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int")
    settings = neighbours.NeighbourSettings(block=256)
    queries = table.filter("vec_id % 50 = 0")
    got = neighbours.nearest_neighbours(table, queries, "vec_id", "embedding", settings).orderBy("query_id", "rank").collect()
    stored = np.array([r[1] for r in rows[:900]], dtype=np.float32).astype(float)
    hits = total = 0
    for q in range(0, 900, 50):
        mine = [r for r in got if r.query_id == q]
        scores = neighbours.cosines(stored[q], stored)
        best = sorted((-s, k) for k, s in enumerate(scores) if k != q)[:5]
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(r.score == scores[r.vec_id] for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({k for _, k in best} & {r.vec_id for r in mine})
        total += 5
    assert hits / total >= 0.9
    assert [(r.rank, r.vec_id) for r in got if r.query_id == 100] == [(k, 100 + k) for k in range(1, 6)]
    assert [(r.rank, r.vec_id) for r in got if r.query_id == 2100] == [(1, 2101)]
    assert {r.query_id for r in got} == {*range(0, 900, 50), 2100}
    assert neighbours.nearest_neighbours(table.limit(0), queries, "vec_id", "embedding").count() == 0
    assert neighbours.nearest_neighbours(table, queries.limit(0), "vec_id", "embedding").count() == 0


@pytest.fixture(scope="module")
def folder(spark):
    """Documents with toxic ones, repeated lines, near copies and leaks of a benchmark item."""
    rng = random.Random(7)
    words = [f"term{i}" for i in range(900)]
    item = " ".join(rng.choice(words) for _ in range(20))

    def line(n):
        return " ".join(rng.choice(words) for _ in range(n))

    footer = "this footer stands under every document of the site"
    rows, labels = [], []
    for k in range(300):
        text = "\n".join([line(30), line(30)] + ([footer] if k % 2 else []))
        kind = "toxic" if k % 5 == 0 else "leak" if k % 31 == 0 else "plain"
        text = text + " grimble worst" if kind == "toxic" else text + "\n" + item.upper() + " end" if kind == "leak" else text
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, 1, int(kind == "toxic")))
    base = " ".join(rng.choice(words) for _ in range(200))
    near = [base, base + " more words at the end", base.replace(base.split()[100], "other", 1)]
    rows += [(1000 + i, t, "en", None, len(t)) for i, t in enumerate(near)]
    rows += [(2000, None, None, "s1", None), (2001, "", "en", "s1", 0), (None, "text without an id", "en", "s2", 18)]
    path = fresh_path(spark, "folder")
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.stage(step(spark, docs, folder), name)
        steps[name] = (before, {r.doc_id: r for r in docs.collect()})
        if name != "mixing":
            assert docs.columns == columns
    gone = {name: set(a) - set(b) for name, (a, b) in steps.items()}
    assert gone["toxicity"] == {k for k in range(0, 300, 5)}
    assert not gone["line_dedup"]
    cleaned = steps["line_dedup"][1]
    footers = [k for k, r in cleaned.items() if "this footer" in (r.text or "")]
    assert footers == [1] and all(r.n_chars == len(r.text) for r in cleaned.values() if r.text is not None)
    before, after = steps["near_dedup"]
    sets = {k: shingle_set(r.text, 5) for k, r in before.items() if k is not None}
    drop = {
        b for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    assert gone["near_dedup"] == drop == {1001, 1002}
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    leaks = {k for k, r in steps["decontamination"][0].items() if overlap_words(r.text, item.split())}
    assert gone["decontamination"] == leaks and leaks
    taken = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("pass").alias("m")).collect()
    assert all(r.n == r.m <= 3 for r in taken)
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_index_parts_give_the_same_overlaps(spark):
    docs = docs_of(spark, [(1, "a b c d e f g h i j k l m n o p")])
    bench = spark.createDataFrame([(k, "a b c d e f g h i j k l m n") for k in range(30)], "item_id long, text string")
    settings = decontamination.OverlapSettings(part_words=60)
    assert decontamination.find_overlaps(docs, bench, settings).count() == 30
