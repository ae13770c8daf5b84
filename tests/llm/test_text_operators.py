"""Corpus operators on small tables: brute-force results, nulls, empty and long texts, ties, repeats, extra columns."""


import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickerloom.llm import chat, decontamination, hyperminhash, line_dedup, mixing, repeats, token_counts, toxicity, words
from tickerloom.llm.filters import key_filter, passes, place_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", node long, component string, spans string, score string, size int, key int"


def docs_of(spark, rows):
    """Documents from ``(id, text)`` or ``(id, text, source)``, with columns whose names operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", "y", "z", 5, 6) for r in rows]
    return spark.createDataFrame(full, EXTRA)


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, size):
    w = tokens(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def overlap_words(text, item):
    """Whether a text holds 13 words in a row (or the whole of a shorter item) with few enough substitutions."""
    t = re.findall(r"[a-z0-9é]+", (text or "").lower())
    width, allowed = min(13, len(item)), 2 if len(item) >= 13 else 1
    return len(item) >= 8 and any(
        sum(x == y for x, y in zip(t[i : i + width], item[j : j + width])) >= width - allowed
        for i in range(len(t) - width + 1) for j in range(len(item) - width + 1)
    )


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def noisy(rng, base, edits):
    w = base[:]
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_shingle_sets_equal_plain_python():
    texts = ["A b c", "a  B c d\n", None, "", "x", "a b c d e a b c d e", "  ", "é É b\tc\x0bd", "a\x00b c d"]
    for size in (1, 3, 5):
        values, offsets = words.shingle_sets(pa.array(texts), size)
        assert np.diff(offsets).tolist() == [len(shingle_set(t, size)) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts * 50)], ["text"])
    whole = [len(shingle_set(t, 3)) for t in texts * 50]
    cut = [n for b in words.blocks(iter([batch]), limit=7) for n in np.diff(words.shingle_sets(b.column(0), 3)[1]).tolist()]
    assert cut == whole


@pytest.mark.parametrize("settings", [hyperminhash.NearSettings(), hyperminhash.NearSettings(5, 80, 40, 4)])
def test_near_duplicates_equal_all_pairs(spark, settings):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        rows += [noisy(rng, base, rng.randrange(len(base) // 12 + 2)) for _ in range(9)]
    rows += [rows[0], rows[0].upper(), rows[0] + " \n", "one", "one", "one two", "", "", None, "  "]
    rng.shuffle(rows)
    table = list(enumerate(rows, start=3)) + [(None, rows[0]), (3, rows[0])]
    got = hyperminhash.near_duplicates(docs_of(spark, table), settings).collect()
    assert len(got) == len(table)
    sets = {i: shingle_set(t, settings.words) for i, t in enumerate(rows, start=3)}
    linked = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= settings.percent * len(sets[a] | sets[b]) and sets[b]
    ]
    want = classes(sets, linked)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.doc_id != 3:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_repeated_rows_inside_a_chain_are_linked(spark):
    """Neighbours in a chain share 93 of 107 words, others too few; the smallest member is a partner of the second alone."""
    settings = hyperminhash.NearSettings(words=1, percent=85, bands=4, rows=1)
    chain = {c: [[f"c{c}w{i}" for i in range(7 * k, 7 * k + 100)] for k in range(4)] for c in range(12)}
    rows = [(10 * c + k, " ".join(w)) for c, parts in chain.items() for k, w in enumerate(parts)]
    rows += [(10 * c + 2, " ".join(parts[2])) for c, parts in chain.items()]
    got = hyperminhash.near_duplicates(docs_of(spark, rows), settings).collect()
    assert len(got) == 60 and [r for r in got if r.component_id != r.doc_id // 10 * 10] == []


def test_texts_of_one_id_each_keep_their_links(spark):
    a, b, c = ([f"{name}{i}" for i in range(60)] for name in "abc")
    rows = [(5, a), (5, b), (9, [*a, "x"]), (12, [*b, "x"]), (30, c), (21, [*c, "x"]), (30, a[:20]), (41, [*a[:20], "y"])]
    rows = [(i, " ".join(w)) for i, w in rows] + [(41, None), (30, " ".join(c)), (None, " ".join(a))]
    got = hyperminhash.near_duplicates(docs_of(spark, rows)).collect()
    found = sorted(((r.doc_id, r.component_id) for r in got if r.n_shingles and r.doc_id is not None))
    assert found == [(5, 5), (5, 5), (9, 5), (12, 5), (21, 21), (30, 21), (30, 21), (30, 21), (41, 21)]
    assert [(r.component_id, r.kept) for r in got if not r.n_shingles or r.doc_id is None] in (
        [(41, True), (None, True)], [(None, True), (41, True)]
    )


def test_registers_estimate_similarity_and_borrow():
    settings = hyperminhash.NearSettings(bands=200, rows=5)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for size, shared in ((1000, 800), (1000, 200), (40, 30)):
        a, b = pool[:size], np.concatenate((pool[:shared], pool[-(size - shared):]))
        values, offsets = np.concatenate((a, b)), np.array([0, size, 2 * size])
        left, right = hyperminhash.registers_of(values, offsets, settings)
        guess = hyperminhash.estimated_similarity(np.array([(left == right).sum()]), np.array([size]), np.array([size]), settings)
        assert abs(guess[0] - shared / (2 * size - shared)) < (0.2 if size == 40 else 0.08)
    one = hyperminhash.registers_of(pool[:1], np.array([0, 1, 1]), settings)
    assert (one[0] != 0).any() and (one[1] == hyperminhash.compress(np.array([2**64 - 1], np.uint64), 10)[0]).all()


def test_every_tolerated_overlap_holds_a_seed_hit():
    settings = decontamination.OverlapSettings()

    def hit(width, bad):
        return any(
            all(bit == "0" or o + k not in bad for k, bit in enumerate(m)) for m in settings.masks for o in range(width - len(m) + 1)
        )

    assert all(hit(13, set(bad)) for bad in itertools.combinations(range(13), 2))
    assert all(hit(n, {k}) for n in range(8, 13) for k in range(n))


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (7, 8, 12, 13, 30, 40)]
    rows = []
    for k in range(60):
        item = rng.choice(items)
        part = item[rng.randrange(max(1, len(item) - 14)) :][: rng.choice([8, 13, 20, 40])]
        text = [rng.choice(vocabulary) for _ in range(20)] + tokens(noisy(rng, part, rng.randrange(4))) + ["end"] * 5
        rows.append((k, " ".join(text).upper() if k % 3 else ", ".join(text)))
    rows += [(None, " ".join(items[4])), (70, None), (71, ""), (72, "É " * 20), (5, " ".join(items[5]))]
    bench = spark.createDataFrame(
        [(i, " ".join(w), 1) for i, w in enumerate(items)] + [(90, None, 1), (91, "", 1), (92, "é " * 20, 1)], "item_id long, text string, doc_id int"
    )
    item_words = {i: w for i, w in enumerate(items)} | {92: ["é"] * 20}

    want = sorted(((d, i) for d, t in rows for i, w in item_words.items() if overlap_words(t, w)), key=str)
    docs = docs_of(spark, rows)
    for size in (10**6, 40):  # one part and several
        settings = decontamination.OverlapSettings(part_words=size)
        got = decontamination.find_overlaps(docs, bench, settings).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == want
        assert all(0 <= r.first_word < r.end_word and 0 < r.similarity <= 1 for r in got)
        left = decontamination.drop_overlapping(docs, bench, settings)
        assert left.columns == docs.columns and left.count() == len(rows) - len({d for d, _ in want})
    assert decontamination.find_overlaps(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_overlapping(docs, bench.limit(0)).count() == len(rows)


def test_repeated_keys_do_not_grow_what_the_driver_holds(spark):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item)] * 50 + [(None, item)] * 3 + [(2, item + " x")], "item_id long, text string")
    parts = list(decontamination.seed_indexes(bench, decontamination.OverlapSettings()))
    assert sum(len(p.ids) for p in parts) == 3
    docs = docs_of(spark, [(7, item), (8, "other")])
    found = decontamination.find_overlaps(docs, bench).groupBy("doc_id", "item_id").count().collect()
    assert {tuple(r) for r in found} == {(7, 1, 50), (7, None, 3), (7, 2, 1)}
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    repeated = docs_of(spark, [(k, f"text {k}") for k in range(40)] * 5)
    rows = toxicity.training_rows(repeated, labels)
    assert rows.count() == labels.filter(~toxicity.held_out(F.col("doc_id"))).count()


def test_banded_distance_equals_levenshtein(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(600):
        a = [rng.choice("abé") for _ in range(rng.randrange(14))]
        b = a[:]
        for _ in range(rng.randrange(5)):
            spot = rng.randrange(len(b) + 1)
            b[spot : spot + rng.randrange(2)] = [rng.choice("abé")] * rng.randrange(2)
        pairs.append(("".join(a), "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        both = table.select(F.levenshtein("a", "b").alias("d"), line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("w"))
        assert all((r.d <= edits) == r.w for r in both.collect())


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_equals_brute_force(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcd é") for _ in range(n)) for n in (19, 20, 21, 40, 41, 90)]

    def changed(line):
        line = list(line)
        for _ in range(rng.randrange(4)):
            spot = rng.randrange(len(line))
            line[spot : spot + rng.randrange(2)] = [rng.choice("abcd")] * rng.randrange(2)
        return "".join(line)

    rows = [(k, "\n".join([changed(rng.choice(base)) for _ in range(6)] + ["short", "x" * 5000])) for k in range(40)]
    rows += [(50, None), (51, ""), (None, rows[0][1]), (52, "\n\n"), (53, rows[1][1])]
    settings = line_dedup.LineSettings(edits=edits)
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, settings).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    first = {}
    for k, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for at, line in enumerate(text.split("\n")):
            if len(line) >= 20:
                first.setdefault(line, (k, at))
    place = sorted(first.values())
    line_at = {first[line]: line for line in first}
    near = [
        (a, b) for a, b in itertools.combinations(place, 2)
        if abs(len(line_at[a]) - len(line_at[b])) <= edits and max(map(len, (line_at[a], line_at[b]))) < 5000
        and distance(line_at[a], line_at[b]) <= edits
    ]
    head = classes(place, near)
    for k, text in rows:
        lines = text.split("\n") if text is not None else []
        stay = [x for i, x in enumerate(lines) if k is None or len(x) < 20 or (first[x] == (k, i) and head[k, i] == (k, i))]
        want = None if text is None else "\n".join(stay)
        assert (got[k].text, got[k].n_lines, got[k].n_removed) == (want, len(lines), len(lines) - len(stay))
    assert line_dedup.dedup_lines(docs.limit(0), settings).count() == 0


def test_query_drops_lines_two_edits_away_and_equal_short_ones(spark, tmp_path):
    near = ("the quick brown fox jumps over it", "the quick brawn fox jumps over is", "the quiet brawn fox jumps over is")
    rows = [(1, near[0] + "\n\nshort é\nshort e"), (2, near[1] + "\n\nshort é\n \nother"), (3, near[2] + "\nshort é\nother\n\n ")]
    docs_of(spark, rows + [(4, "q" * 40 + "\nshort")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0), 2: (5, 2), 3: (5, 3), 4: (2, 0)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    piped = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert (piped[2], piped[3]) == ("\n \nother", "\n ")


def test_line_dedup_runs_no_python(spark):
    docs = docs_of(spark, [(1, "a" * 30), (2, "a" * 30)])
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_column_sort_equals_sorted_suffixes():
    rng = random.Random(5)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 40))]
        sizes = np.array([len(t) for t in texts])
        text, size, shared = repeats.column_sort(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
        suffixes = [texts[i][len(texts[i]) - n :] for i, n in zip(text.tolist(), size.tolist())]
        assert suffixes == sorted(suffixes) and len(suffixes) == sizes.sum() + len(texts)
        for a, b, n in zip(suffixes, suffixes[1:], shared[1:].tolist()):
            assert a[:n] == b[:n] and (n in (len(a), len(b)) or a[n] != b[n])


def test_repeats_equal_brute_force(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdeéf ") for _ in range(n)) for n in (49, 50, 51, 120, 600)]
    rows = [
        (k, "".join(rng.choice(passages) if rng.random() < 0.6 else f"<{rng.randrange(10**9)}>" for _ in range(8))) for k in range(1, 40)
    ]
    rows += [(60, None), (61, ""), (62, "z" * 5000), (63, "z" * 70), (5, rows[7][1]), (None, passages[4]), (None, passages[4])]
    settings = repeats.RepeatSettings(filter_bits=12, collection=8)
    got = repeats.drop_repeats(docs_of(spark, rows), settings).collect()
    firsts: dict[bytes, float] = {}
    coded = [(float("inf") if k is None else k, (t or "").encode()) for k, t in rows]
    for k, data in coded:
        for i in range(len(data) - 49):
            firsts[data[i : i + 50]] = min(firsts.get(data[i : i + 50], k), k)
    want = []
    for k, data in coded:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if firsts[data[i : i + 50]] < k:
                gone[i : i + 50] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(data) else 0
        want.append((str(k), len(data), int(gone.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~gone])))
    mine = [(str(float("inf") if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
    assert sorted(mine) == sorted(want)
    assert repeats.drop_repeats(docs_of(spark, []).limit(0), settings).count() == 0


def test_toxicity_learns_folds_and_excuses(spark):
    rng = random.Random(2)
    fill = [f"word{i}" for i in range(200)]
    rows = []
    for k in range(400):
        body = [rng.choice(fill) for _ in range(rng.choice([5, 60]))]
        rows.append((" ".join(body + (["vilebad", "gromwort" + rng.choice("abc")] if k % 4 == 0 else [])), int(k % 4 == 0)))
    rows += [(None, 1), ("x", None)]
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    lexicon = toxicity.learn_lexicon(labelled, toxicity.ToxicitySettings(exceptions=("vilebad weed",)))
    texts = ["you VILEBAD one", "v1l3b4d word1", "vіlebаd", "gromwortzz", "a vilebad weed", "word1 word2", "", None, "vile​bad"]
    scores = lexicon.score(texts)
    assert all(scores[[0, 1, 2, 3, 8]] >= 0.5) and all(scores[[4, 5, 6, 7]] < 0.5)
    docs = docs_of(spark, [(k, t) for k, t in enumerate(texts)] + [(None, "vilebad gromworta " * 20_000)])
    out = toxicity.score_toxicity(docs, lexicon).collect()
    assert len(out) == 10 and all(0 <= r.score <= 1 for r in out) and max(out, key=lambda r: len(r.text or "")).score >= 0.5
    empty = toxicity.learn_lexicon(labelled.filter("toxic = 0"))
    assert not empty.weights and (empty.score(texts) < 0.5).all()
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0


def test_chat_round_trip_and_merging(spark):
    rng = random.Random(6)
    nasty = ["\\", "### ", "</turn>", "\n", ": ", "\\h", "\\b", "user", "é", "", "### assistant: "]
    rows = [
        (c, t, rng.choice(["user", "assistant", "a:b", None]), "".join(rng.choice(nasty) for _ in range(rng.randrange(6))) or None, "x")
        for c in range(30) for t in range(rng.randrange(1, 9))
    ]
    rows += [(None, 1, "user", "hi", "x"), (99, None, "assistant", "late", "x"), (99, 0, "user", "q", "x"), (99, 0, "user", "q", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(turns)
    read = done.select("conv_id", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("l"), "formatted")
    for r in read.collect():
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.t] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.l == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.formatted.count("### ") == sum(1 for _ in itertools.groupby(x[2] or "" for x in mine))
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_length_histogram_answers_every_limit(spark):
    texts = ["a b c", "a b c", "<|endoftext|>", "", None, "word " * 3000, "é" * 50]
    docs = docs_of(spark, list(enumerate(texts)))
    lengths = {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(docs).collect()}
    encode = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN).encode_ordinary
    assert lengths == {k: len(encode(t or "")) for k, t in enumerate(texts)} and lengths[2] > 1
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(docs)).cache()
    for r in histogram.collect():
        n, inside = r.n_tokens, [x for x in lengths.values() if x <= r.n_tokens]
        assert (r.docs_within, r.tokens_within) == (len(inside), sum(inside))
        assert (r.docs_beyond, r.tokens_beyond) == (len(texts) - len(inside), sum(lengths.values()) - sum(inside))
        assert r.tokens_truncated == sum(min(x, n) for x in lengths.values()) and r.quantile == len(inside) / len(texts)
    for limit in (0, 1, 4, 1000, 10**6):
        assert token_counts.truncated_total(histogram, limit) == sum(min(x, limit) for x in lengths.values())
    assert token_counts.length_quantile(histogram, 0.5) == sorted(lengths.values())[3]
    assert token_counts.length_histogram(token_counts.encoded_lengths(docs.limit(0))).count() == 0


def test_mixing_follows_weights_caps_and_budget(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randrange(30), f"s{k % 7 if k % 3 else 0}") for k in range(700)] + [(None, "w w", None), (3, "w", "s0"), (3, "w", "s0"), (900, None, "s1"), (901, "", None)]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    again = mixing.mix_sources(docs_of(spark, rows[::-1])).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    total = sum(size.values())
    assert total - 30 <= sum(taken.values()) <= total
    assert abs(sum(target.values()) - total) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 31 and target[s] <= 3 * size[s] + 1e-9 for s in size)
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), [5, 2, 1] * 3))
    free = {s for s in size if target[s] < 3 * size[s] - 1e-9}
    assert len({round(target[s] / weights[s], 6) for s in free}) == 1
    assert all(3 * size[s] / weights[s] <= target[f] / weights[f] + 1e-9 for s in set(size) - free for f in free)
    assert mixing.mix_sources(docs_of(spark, []).limit(0)).count() == 0


def test_pieces_travel_in_bounded_space_however_many_buckets_there_are():
    rng = np.random.default_rng(5)
    ids = np.sort(rng.choice(10**12, 3000, replace=False))
    piece = np.sort(rng.integers(0, 2**48, 60_000).astype(np.uint64))
    index = rng.integers(0, len(ids), len(piece))
    for bits in (0, 6, 14, 20):
        (batch,) = repeats._dealt(piece >> np.uint64(48 - bits), piece, index, ids)
        taken = [repeats._taken(batch, row) for row in range(batch.num_rows)]
        assert np.array_equal(np.concatenate([p for p, _ in taken]), piece)
        assert np.array_equal(np.concatenate([w for _, w in taken]), ids[index])
        sent = sum(batch.column(c).nbytes - 4 * (batch.num_rows + 1) for c in ("high", "low", "who", "ids"))
        assert sent <= 16 * len(piece) and batch.num_rows <= 1 << bits


def test_the_mix_takes_rows_of_one_id_each_for_itself(spark):
    rows = [(7, "a b c d e f", "s"), (7, "g h", "t"), (None, "i j k", "t"), (None, "l", "s"), (8, "m n", None), (8, "m n", None)]
    rows += [(9, "o p q r", "u"), (10, "", "u"), (11, None, "s"), (None, "x", None)]
    docs = spark.createDataFrame(
        [(i, t, None, s, len(t or ""), 3, 4) for i, t, s in rows], DOCS + ", pass int, __first long"
    )
    got = corpus_pipeline.mix(spark, docs, "").collect()
    assert sorted(got[0].asDict()) == ["__first", "doc_id", "lang", "n_chars", "pass", "source", "text"]
    want = {}
    for r in mixing.mix_sources(docs.withColumn("text_", F.col("text")), carry=("text_",)).collect():
        key = (r.doc_id, r.text_, r.source)
        want[key] = want.get(key, 0) + r.copies
    counted = {}
    for r in got:
        counted.setdefault((r.doc_id, r.text, r.source), []).append(r["pass"])
    assert {k: sorted(v) for k, v in counted.items()} == {k: list(range(1, n + 1)) for k, n in want.items() if n}
    assert corpus_pipeline.mix(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "string", "int", "date"])
def test_overlaps_keep_any_type_of_id(spark, kind):
    text = " ".join(f"word{k}" for k in range(20))
    cast = (lambda c: F.date_add(F.lit("2020-01-01"), F.col(c).cast("int"))) if kind == "date" else (lambda c: F.col(c).cast(kind))
    docs = docs_of(spark, [(1, text), (2, "other words")]).withColumn("doc_id", cast("doc_id"))
    items = spark.createDataFrame([(3, text), (None, text)], "item_id int, text string").withColumn("item_id", cast("item_id"))
    found = decontamination.find_overlaps(docs, items)
    assert [found.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")] == [kind, kind]
    want = [(r.doc_id, r.item_id) for r in docs.limit(1).crossJoin(items).select("doc_id", "item_id").collect()]
    assert sorted(map(str, [(r.doc_id, r.item_id) for r in found.collect()])) == sorted(map(str, want))


def test_windows_of_a_frequent_segment_are_laid_out_some_at_a_time():
    """A segment of 31 windows that occurs 200,000 times: 6.2 million windows, of which a million are held at once."""
    n, out = 200_000, np.array([0, 31, 33])
    keeper = np.concatenate([np.where(np.arange(31) % 10 < 5, 1, 9), [0, 9]])
    kind, limit = np.zeros(n, np.int64), np.full(n, 5)
    kind[7], limit[11] = 1, 0
    live = np.flatnonzero(limit > 0)
    tracemalloc.start()
    found = list(repeats.covered(live, kind, out, keeper, limit))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    owner, first, last = (np.concatenate(f) for f in zip(*found))
    runs = list(zip(owner.tolist(), first.tolist(), last.tolist()))
    whole = [(0, 4), (10, 14), (20, 24), (30, 30)]
    assert runs == [(k, a, b) for k in live.tolist() for a, b in ([(0, 0)] if k == 7 else whole)]
    assert peak < 100e6
    assert list(repeats.covered(live[:0], kind, out, keeper, limit)) == []


def test_a_filter_of_keys_is_one_job(spark):
    keys = spark.range(0, 5000, 7, 40).withColumn("id", F.col("id") * 3)
    tracker, group = spark.sparkContext.statusTracker(), "key_filter"
    spark.sparkContext.setJobGroup(group, group)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    table = key_filter(keys, "id")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    places = np.array([r.p for r in keys.select(place_of("id").alias("p")).collect()])
    assert passes(table, places).all() and int(np.bitwise_count(table).sum()) == len(set(places.tolist()))
    assert jobs <= 2
