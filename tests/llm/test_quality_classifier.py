import re

import numpy as np
import pyarrow as pa
import pytest

from verbatlas.llm import quality_classifier as q
from verbatlas.llm import words as w

SF = "/root/testdata/sf0.01"


def test_words_and_hashes():
    texts = ["Ab  cd\tAB", "", None, " x\n", "É é", "ab"]
    h, first = w.word_hashes(pa.array(texts))
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert np.diff(first).tolist() == [len(x) for x in want]
    flat = [x.lower() for ws in want for x in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(h)) for j in range(len(h)))
    assert w.word_hashes(pa.array([], pa.string()))[0].size == 0
    assert w.slices(pa.array(["a" * 10, None, "b" * 3, "c" * 100]), 12) == [(0, 2), (2, 3), (3, 4)]


def test_shape_measures():
    t = q.Texts(pa.array(["word " * 30, "a#b " * 30, "AA!! " * 30, "x | " * 30, None, "", "Éa éA"]))
    assert t.count.tolist() == [30, 60, 30, 30, 0, 0, 2]
    s = t.shape
    assert s["doubled"][0] > 0.5 and s["tagged"][1] > 0.5 and s["upper"][2] > 0.5 and s["bangs"][2] > 0.5 and s["bare"][3] > 0.4
    assert t.words[-1] == t.words[-2]
    v = q.votes(t, np.zeros(2**q.BITS, bool))
    assert not v[4:6].any() and (v[:4] == 2).any(axis=1).all()
    # a batch gives what its texts give alone
    one = q.Texts(pa.array(["a#b " * 30]))
    assert all(np.isclose(one.shape[k][0], s[k][1]) for k in s)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(40_000) < 0.8
    m = len(q.LABELLERS)
    v = np.ones((len(good), m), np.int8)
    for k in range(m):
        v[good & (rng.random(len(good)) < 0.002), k] = 2
    kind = rng.integers(0, m // 2, len(good))
    for k in range(m // 2):  # a poor text shows one defect, that two labellers see
        for j in (2 * k, 2 * k + 1):
            v[~good & (kind == k) & (rng.random(len(good)) < 0.9), j] = 2
    pats, inv, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, chances, share = q.expectation_maximisation(pats, counts.astype(float))
    # disjoint defects are not independent, as the model takes them to be: the share comes out somewhat low
    assert 0.65 < share < 0.85 and (chances[0][:, 2] < 0.03).all()
    found = post[inv.ravel()] < 0.5
    assert found[~good].mean() > 0.85 and found[good].mean() < 1.2 * m * 0.002  # no more than have any vote against them


def test_sample_holds_rare_patterns():
    counts = np.array([1_000_000.0, 50_000.0, 40.0, 7.0, 3.0])
    rates = q.sample_rates(counts, 12_000)
    assert (rates[2:] == 1).all() and 11_000 < (rates * counts).sum() <= 12_001
    assert (rates * counts)[0] > 0.5 * 0.5 * 12_000 and (q.sample_rates(counts, 2_000_000) == 1).all()


def test_sample_is_weighted():
    rows = [np.array([5])] * 100 + [np.array([6])] * 100
    even = q.train_linear(rows, np.array([1.0] * 100 + [0.0] * 100))[1]
    assert q.train_linear(rows, np.array([1.0] * 100 + [0.0] * 100), counts=np.array([9.0] * 100 + [1.0] * 100))[1] > even


def test_linear_scorer_separates():
    rows = [np.array([5, 10 + i % 50]) for i in range(400)] + [np.array([6, 10 + i % 50]) for i in range(400)]
    weights, bias = q.train_linear(rows, np.array([1.0] * 400 + [0.0] * 400))
    assert bias + weights[5] > 1 and bias + weights[6] < -1
    assert q.train_linear([], np.array([]))[0].any() == np.False_


@pytest.fixture(scope="module")
def on_table(spark):
    return q.op10_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()


def test_held_to_labels(on_table):
    clean = [r.kept for r in on_table if r.quality == 1 and r.toxic == 0]
    poor = [r.kept for r in on_table if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(poor) <= 0.1 * len(poor)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= q.THRESHOLD) for r in on_table)


def test_abuse_is_rejected(spark):
    # abusive words, of unlike beginnings, rare enough that none has a weight of its own: only the lexicon's hits can tell
    plain = [f"w{i % 97} quiet{i % 89} river{i % 83} stone{i % 79} valley{i % 73} morning{i % 71} walks{i % 67} gently{i % 61} along{i % 59} paths{i % 53}" for i in range(600)]
    bad = [f"{t} {' '.join(chr(97 + (i + k) % 11) * 5 + 'zz' for k in range(3))}" for i, t in enumerate(plain[:30])]
    rows = list(enumerate(plain + bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 600)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    kept = {r.doc_id for r in q.scored(docs, model).where(f"score >= {q.THRESHOLD}").collect()}
    assert model.lexicon.any() and not kept & set(range(600, 630)) and len(kept) >= 590
    # a text that the scorer hasn't seen, whose words have no weight
    new = spark.createDataFrame([(1, "fresh unseen words stand here and bbbbbzz then hhhhhzz with eeeeezz at its end")], "doc_id long, text string")
    assert q.scored(new, model).first().score < q.THRESHOLD


def test_candidates_are_not_capped(spark):
    # more common words in abusive texts than any cap on candidates would hold, and one rare abusive word
    common = [f"c{i:05d}" for i in range(18_000)]
    docs = spark.createDataFrame([(i, " ".join(common) + (" slurzz" if i < 6 else "")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 12)) for i in range(60)], "doc_id long, quality int, toxic int")
    flags = q.learn_lexicon(docs, labels)
    assert q.Texts(pa.array(["slurzz"])).hits(flags).tolist() == [1.0]


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "word", "y"), (4, "word", "y"), (5, "Fine words stand here. " * 3000, "z"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (None, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    model = q.fit(docs, labels.limit(0))
    got = q.scored(docs.drop("score"), model).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 4}) == 1
    assert q.keep_good(docs.limit(0), labels).count() == 0


def test_clashing_names(spark):
    names = ["doc_id", "text", "row", "score", "_score", "place", "a.b", "Score2"]
    rows = [(i, "some plain words about nothing much", *range(6)) for i in range(12)]
    docs = spark.createDataFrame(rows, names)
    out = q.keep_good(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert out.columns == names and sorted(map(tuple, out.collect())) == rows
