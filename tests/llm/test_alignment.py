import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import alignment as A
from tickerloom.llm import token_counts
from tickerloom.llm.byte_pairs import encode_ordinary

PATHS = A.AlignSettings()
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
SIGNS = A._byte_signs()


@pytest.fixture(scope="module")
def public():
    a = tokenizers.Tokenizer.from_file(PATHS.a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS.b)


def whole_tokens(text, public):
    """(id, bytes) of both sides by the public libraries over the whole text, or None."""
    a, b = public
    if not text:
        return None
    one = a.encode(" " + text, add_special_tokens=False)
    left = [(n, bytes(SIGNS[c] for c in a.id_to_token(n))) for n in one.ids]
    right = []
    for n in b.encode(text):
        name = b.id_to_piece(n)
        right.append((n, bytes([int(name[3:5], 16)]) if b.is_byte(n) else name.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else None


def brute_force(texts, public):
    sides = [whole_tokens(t, public) for t in texts]
    found, counts = [], Counter()
    for side in sides:
        spans = []
        for tokens in side or ((), ()):
            at, out = 0, []
            for n, value in tokens:
                out.append((n, at, at + len(value)))
                at += len(value)
            spans.append(out)
        pairs = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        counts.update(pairs)
        found.append((spans, pairs))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for spans, pairs in found:
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        named, last = [], 0
        for end in ends:
            named.append("|".join(",".join(str(n) for n, s, e in side if last <= s and e <= end) for side in spans))
            last = end
        rows.append((
            len(spans[0]), len(spans[1]), len(ends), len(pairs), sum(counts[p] == best[p[1]] for p in pairs),
            sum(counts[p] for p in pairs), ";".join(named),
        ))
    return rows


def aligned(spark, texts, limit=1 << 20, digest=False):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = A.align_tokenizers(docs, A.AlignSettings(window_bytes=4 * limit, block_bytes=limit), digest).orderBy("doc_id").collect()
    return [tuple(r[c] for c in COLUMNS) for r in rows]


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "", None, " ", "  two  spaces  ", "a", "tab\tand\nline\n\n\nbreaks  ",
    "<|endoftext|> and <s> </s> <unk> <0x41> stay text", "déjà vu — “quoted” naïve, 漢字かな交じり文 🙂👩‍👩‍👧", "a ▁ b", "x▁y",
    "it's they'll DON'T we've 1234567 3.14159 a_b-c/d", " non breaking 　wide", "word " * 50, "The quick brown fox",
    "z" * 3000, "\x1c \x1d\x00 end",
]


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_equals_whole_texts_token_by_token(spark, public, limit):
    want = brute_force(TEXTS, public)
    assert want[9][0] == 0 and want[3][0] > 0  # the piece model reads U+2581 as a space
    assert aligned(spark, TEXTS, limit) == want


def test_given_documents(spark, public):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = [t[:1500] for t in texts]
    want = brute_force(texts, public)
    assert aligned(spark, texts, 5000) == want
    digests = [hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in want]
    assert [r[-1] for r in aligned(spark, texts, 5000, True)] == digests


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" ab'sé1.\n\t ▁漢<x>-")), max_size=40), min_size=1, max_size=6))
def test_parts_encode_as_in_their_text(public, texts):
    both = [A.tokenizer(A.ByteLevel, PATHS.a), A.tokenizer(A.Pieces, PATHS.b)]
    texts = [t for t in texts if t] or ["a"]
    a, b = A.Window(pa.array(texts), both).tokens(0, len(texts))
    for k, text in enumerate(texts):
        want = whole_tokens(text, public) or ([], [])
        assert [a.ids[a.text == k].tolist(), b.ids[b.text == k].tolist()] == [[n for n, _ in side] for side in want]


def test_long_blanks_are_encoded_as_the_pattern_would():
    encoding = A.tokenizer(A.ByteLevel, PATHS.a).encoding
    for text in ("a" + " " * 6000 + "b c", "a" + " " * 6000, "\n" * 5000 + "x" + " \t" * 3000 + " y", " " * 5001 + "\n." + "　" * 7000):
        assert encode_ordinary(encoding, text) == encoding.encode_ordinary(text)
    assert len(encode_ordinary(encoding, "a" + " " * 1_000_000 + "b")) == 1_000_001


def test_hostile_tables(spark, public):
    kinds = "doc_id string, text string, block int, pair string, links int, n_a string"
    rows = [("x", "some words", 1, "p", 2, "n"), ("x", "some words", 1, "p", 2, "n"), (None, None, None, None, None, None)]
    got = A.align_tokenizers(spark.createDataFrame(rows, kinds)).orderBy("doc_id").collect()
    want = brute_force(["some words", "some words"], public)[0]
    assert [r.doc_id for r in got] == [None, "x", "x"] and tuple(got[1])[1:] == tuple(got[2])[1:] == want
    assert tuple(got[0])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert A.align_tokenizers(spark.createDataFrame([], kinds)).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(r.n_links for r in A.align_tokenizers(empty).collect()) == [0, 0]


def test_token_counts_of_long_blanks(spark):
    texts = ["a" + " " * 1_000_000 + "b", " " * 1_000_000, "x" * 200_000 + "\n" * 300_000, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lengths = {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(docs).collect()}
    # a blank run is one piece without its last sign; this vocabulary has tokens of single blanks and line feed pairs
    encoding = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    blank = len(encoding._encode_single_piece(" " * 999_999))
    assert lengths[0] == 1 + blank + len(encoding.encode_ordinary(" b"))
    assert lengths[1] == len(encoding._encode_single_piece(" " * 1_000_000)) and lengths[3] == 2
    assert lengths[2] == len(encoding.encode_ordinary("x" * 200_000)) + len(encoding._encode_single_piece("\n" * 300_000))
