import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tickerloom.llm import toxicity as T

WORDS = ["vile", "vilest", "vil", "scum", "pond", "scumbag", "trash", "can", "cans", "class", "clown", "fish", "good", "goodness", "é"]
TERMS = {" vile ": 2.0, " vil": 1.0, " scum": 3.0, " scumbag ": 2.5, " trash ": 1.5, " clown": 4.0, " clown ": 0.5, " é ": 1.0}
EXCUSED = ("pond scum", "trash can", "class clown", "clown fish")


def naive(text, weights, exceptions):
    """Every place against every term, and every phrase against every place."""
    folded = T.fold(text)
    places = {}
    for s, char in enumerate(folded):
        hits = [w for t, w in weights.items() if folded.startswith(t, s)]
        if char == " " and hits:
            places[s] = max(hits)
    for phrase in exceptions:
        p = f" {phrase} "
        for a in range(len(folded)):
            if folded.startswith(p, a):
                places = {s: w for s, w in places.items() if not a <= s < a + len(p) - 1}
    words = Counter(folded[s + 1 :].split(" ")[0] for s in places)
    weight = {folded[s + 1 :].split(" ")[0]: w for s, w in places.items()}
    total = sum(weight[w] * (1 + math.log(n)) for w, n in words.items())
    return math.log1p(total), total / math.sqrt(1 + folded.count(" ") / 100)


def disguised(rng, word):
    swaps = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "l": "l", "c": "с", "t": "7"}
    out = "".join(swaps.get(c, c) if rng.random() < 0.3 else c for c in word)
    out = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and rng.random() < 0.1 else c for c in out)
    return out.upper() if rng.random() < 0.2 else out.replace("l", "l​", 1) if rng.random() < 0.2 else out


def test_matcher_equals_a_naive_one():
    rng = random.Random(11)
    lexicon = T.Lexicon(TERMS, EXCUSED)
    hits = 0
    for _ in range(400):
        parts = [disguised(rng, rng.choice(WORDS)) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", " ", ", ", ".\n", "-", "  "]) for p in parts)
        got = lexicon.features(text)
        assert got == pytest.approx(naive(text, TERMS, EXCUSED))
        hits += got[0] > 0
    assert hits > 200


@pytest.mark.parametrize("word", ["v1le", "VILE", "ｖｉｌｅ", "vi​le", "vіlе"])
def test_folding(word):
    assert T.fold(word) == " vile "


def test_logistic_finds_the_separating_side():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(500, 2)))
    y = (x.sum(axis=1) + rng.normal(0, 0.2, 500) > 2).astype(float)
    bias, slopes = T._logistic(x, y)
    assert bias < 0 < min(slopes)
    assert ((bias + x @ np.array(slopes) > 0) == (y > 0)).mean() > 0.9


def test_query_holds_rows_out_and_cuts_at_one_half(spark):
    folder = "/root/testdata/sf0.01"
    rows = T.op8_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    unseen = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in unseen) >= 0.9 * len(unseen) > 10
