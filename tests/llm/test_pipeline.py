import base64
import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp
from tests.llm.test_ngram_join import brute
from tests.llm.test_quality_rules import brute as base_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The rows that go into each stage and come out of it, by the stages one after the other."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_shape(staged):
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE"]
    assert all(set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for rows in staged[:-1])
    whole = {r.doc_id: tuple(r) for r in staged[0]}
    assert all(tuple(r) == whole[r.doc_id] for rows in staged[1:-1] for r in rows)


def test_classifier_stage(spark, staged):
    left = ids(staged[1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean = [left[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]
    assert sum(clean) >= 0.97 * len(clean)
    poor = [left[r.doc_id] for r in labels if r.quality == 0]
    assert sum(poor) <= 0.35 * len(poor)


def test_rules_stage(staged):
    left = ids(staged[2])
    for r in staged[1]:
        if base_rules(r.text)[-1]:
            assert not left[r.doc_id]
    assert sum(left.values()) >= 0.9 * sum(not base_rules(r.text)[-1] for r in staged[1])


def test_join_stage_against_all_pairs(staged):
    components = brute([(r.doc_id, r.text) for r in staged[2]])
    assert sorted(ids(staged[3])) == sorted({c for _, _, c in components})
    assert set(ids(staged[3]).values()) == {1}


def test_mixing_stage(staged):
    before, after = ids(staged[3]), ids(staged[4])
    assert set(before) == set(after) and sum(after.values()) > sum(before.values())


def test_last_stage_and_run(spark, staged):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in staged[4]:
        own = plain.encode_ordinary(r.text or "")
        want[r.doc_id, len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:3] for r in staged[5]) == want
    again = Counter(tuple(r)[:3] for r in cp.run(spark, SF).collect())
    assert again == want


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three", "en", None, 3), (3, "one two three", "en", None, 3), (None, "a b c d e f " * 9, "fr", "s", 5), (4, "w " * 40_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            assert stage(spark, table, SF).count() <= 3 * len(rows), name
