import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from verbatlas.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = st.sampled_from([*"abAB'strelvm019 \n\t.,!-_", "  ", "don't", "é", "ß", "中", "。", "文", " ", "​", "\x1c", "\x85", "🙂", "'ll", "٣"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join), st.integers(2, 24))
def test_tree_equals_library(plain, text, leaf):
    own = bpe.BpeCodec.__new__(bpe.BpeCodec)
    own._base, own._leaf, own._leaf_ids = plain, leaf, 7
    ids = own.encode(text)
    assert ids == plain.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abethinsor", min_size=1500, max_size=9000))
def test_long_runs_of_letters(plain, text):
    own = bpe.BpeCodec(RANKS, P.PATTERN, leaf_chars=700)
    assert own.encode(text) == plain.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "ab", " ", "\n", "!", "7", "中文", "é", "'s", "the ", "x" * 999 + " "])
def test_pathological_texts(plain, unit):
    text = unit * (40_000 // len(unit))
    own = bpe.BpeCodec(RANKS, P.PATTERN)
    assert own.encode(text) == plain.encode_ordinary(text)


def test_documents(spark, plain):
    texts = [(1, None, "x"), (2, "", "y"), (3, "Hello world's end.\n\n  ok", "z"), (3, "Hello world's end.\n\n  ok", "z"), (4, "word " * 9000, "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.tokenize_documents(df).collect()))
    want = []
    for i, t, _ in texts:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    full = bpe.round_trip(df, RANKS, P.PATTERN)
    again = bpe.decode_ids(full, RANKS, P.PATTERN).collect()
    assert {(r.doc_id, bytes(r.decoded)) for r in again} == {(i, (t or "").encode()) for i, t, _ in texts}
    assert bpe.tokenize_documents(df.limit(0)).count() == 0


def test_query_on_table(spark, plain):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = plain.encode_ordinary(r.text or "")
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


@settings(max_examples=100, deadline=None)
@given(st.lists(ALPHABET, max_size=80).map("".join), st.integers(2, 24))
def test_other_pattern(text, leaf):
    """Cuts are known for one pattern only; any other one gives the library's ids too."""
    pattern = r"[a-z]+[0-9]+|\s|."
    own = bpe.BpeCodec(RANKS, pattern, leaf_chars=leaf) if pattern not in CODECS else CODECS[pattern]
    own._leaf = leaf
    CODECS[pattern] = own
    assert own.encode(text) == own._base.encode_ordinary(text)


CODECS = {}


def test_known_pattern():
    assert bpe.CUT_PATTERN == P.PATTERN


def test_small_flushes(spark, monkeypatch):
    """Results do not depend on where a worker hands on; a bare file name is found on the worker."""
    texts = [(i, "word " * i if i % 7 else None, i) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_tokens long").coalesce(1)
    whole = sorted(map(tuple, bpe.tokenize_documents(df).collect()))
    monkeypatch.setattr(bpe, "FLUSH_BYTES", 100)
    own = bpe.BpeCodec(RANKS, P.PATTERN)
    got = bpe.round_trip(df, "byte_bpe_50k.tiktoken", P.PATTERN)
    assert [(r.doc_id, r.n_tokens, list(r.ids)) for r in got.orderBy("doc_id").collect()] == [(i, len(own.encode(t)), own.encode(t)) for i, t, _ in texts]
    assert [r[:2] for r in whole] == [(i, len(own.encode(t))) for i, t, _ in texts]
