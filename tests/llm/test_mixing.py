import time
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verbatlas.llm import mixing as mx

SF = "/root/testdata/sf0.01"


def bucket(word):
    h = xxhash.xxh64(word.lower().encode(), seed=42).intdigest()
    return (h - 2**64 if h >= 2**63 else h) % mx.BUCKETS


def brute_parts(text, model):
    """n_words and the parts of a text, by plain loops."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    sums = []
    for packed in model.packed:
        total = sum(packed[bucket(w)] for w in words)
        sums += [total & (2**32 - 1), total >> 32]
    logits = np.array(sums[: len(model.domains)]) / (max(1.0, len(words) / mx.EVIDENCE) * mx.SCALE)
    e = np.exp(logits - logits.max())
    return len(words), np.rint(e / e.sum() * mx.STEPS).astype(int).tolist()


def brute_rates(p, t, goal, least=0.0, steps=20_000):
    """Plain projected gradient on every document, for long."""
    a = p * t[:, None]
    scale = 1 / np.maximum((a * p).sum(0), 1e-9)
    r = np.ones(len(t)) * max(1.0, least)
    pace = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * (a.T @ p) * np.sqrt(scale)[None, :]).max()
    for _ in range(steps):
        r = np.maximum(least, r - pace * (p @ (scale * (a.T @ r - goal))))
    return r


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mx.train(mx.labelled_by(docs, labels, "lang"), "doc_id", "text", "lang")
    return docs, labels, model


def test_membership_against_loops(spark, fitted):
    docs, _, model = fitted
    texts = [None, "", " \n", "word", "The the of", "é ü\tß", "der die das " * 5000] + [r.text for r in docs.limit(40).collect()]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, part int").drop("part")
    rows = mx.with_membership(df, model).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        n, part = brute_parts(t, model)
        assert r.n_words == n and np.abs(np.array(r.part) - part).max() <= 1


def test_domains_found(spark, fitted):
    docs, _, model = fitted
    got = mx.op7_mixing(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.domain == r.lang for r in got) >= 0.93 * len(got)
    assert all(r.rate >= 0 and 0 <= r.membership <= 1 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_against_plain_descent(spark, fitted, least):
    docs, _, model = fitted
    members = mx.with_membership(docs, model).select("doc_id", "n_words", "part").cache()
    targets = {"en": 0.3, "de": 0.3, "fr": 0.3, "es": 0.1}
    plan = mx.solve(members, model.domains, targets, least)
    rows = members.withColumn("rate", plan.rate("part")).collect()
    parts = np.array([r.part for r in rows], float)
    p, t = parts / parts.sum(1, keepdims=True), np.array([r.n_words for r in rows], float)
    own = np.array([r.rate for r in rows])
    assert own.min() >= least
    reached = (p * t[:, None]).T @ own
    assert np.allclose(reached, plan.reached, rtol=1e-4)
    plain = (p * t[:, None]).T @ brute_rates(p, t, plan.targets, least)
    scale = 1 / ((p * t[:, None] * p).sum(0))
    error = lambda x: (scale * (x - plan.targets) ** 2).sum()
    assert error(reached) <= 1.05 * error(plain) + 1e-5 * error(plan.start)
    if not least:
        assert np.allclose(reached, plan.targets, rtol=2e-3)


def test_mix(spark, fitted):
    docs, labels, model = fitted
    out = mx.mix(docs, labels)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(times) == {r.doc_id for r in docs.select("doc_id").collect()}
    en = [times[r.doc_id] for r in docs.where("lang = 'en'").select("doc_id").collect()]
    es = [times[r.doc_id] for r in docs.where("lang = 'es'").select("doc_id").collect()]
    assert sum(en) / len(en) < 1.2 < 1.4 < sum(es) / len(es)


def test_native_plan(spark, fitted):
    docs, labels, _ = fitted
    plan = mx.mix(docs.limit(50), labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edge_cases(spark):
    rows = [(1, None, "a", 1.0), (2, "", "a", 1.0), (3, "one two", None, 1.0), (4, "alpha alpha", "a", 1.0), (4, "alpha alpha", "a", 1.0), (None, "beta", "b", 1.0), (6, "beta gamma " * 50_000, "b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate double")
    labels = spark.createDataFrame([(4,), (6,), (None,)], "doc_id long")
    out = mx.mix(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 6, None}
    assert mx.mix(docs, labels.limit(0)).count() == len(rows)
    assert mx.mix(docs.limit(0), labels).count() == 0
    odd = docs.where("doc_id is not null").withColumn("lang", mx.F.concat(mx.F.lit("d"), mx.F.col("doc_id")))  # an odd number of domains
    assert mx.mix(odd, odd.select("doc_id")).count() >= 6


def test_more_words_than_a_packed_sum_holds(spark):
    words = np.zeros((2, mx.BUCKETS), np.int64)
    words[0] = mx.LARGEST
    model = mx.Classifier(["a", "b"], [(words[0] + (words[1] << 32)).tolist()])
    texts = ["w " * 1_000, "w " * 4_198_500, "w " * (mx.SUMMED + 1)]
    rows = mx.with_membership(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).select("n_words", "part").collect()
    assert [(r.n_words, r.part) for r in rows] == [(len(t) // 2, [mx.STEPS, 0]) for t in texts]


def test_clashing_names(spark):
    names = ["doc_id", "text", "lang", "row", "id", "domain", "part", "rate", "copies", "n_words", "_x_part", "_m", "a.b"]
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", "a" if i % 2 else "b", *range(10)) for i in range(20)]
    docs = spark.createDataFrame(rows, names)
    out = mx.mix(docs, docs.select("doc_id"))
    assert out.columns == names and {tuple(r) for r in out.collect()} == set(rows)


def test_many_domains_are_taken_together(spark):
    docs = spark.range(700).selectExpr("id as doc_id", "concat('w', cast(least(id % 100, 90) as string)) as text", "concat('d', cast(least(id % 100, 90) as string)) as lang")
    model = mx.train(docs, "doc_id", "text", "lang")
    assert len(model.domains) == mx.MOST_DOMAINS and mx.OTHERS in model.domains and "d90" in model.domains


def test_many_domains(spark):
    """20 domains, 4,000 documents: moments and rates as numpy has them, in time that does not grow with the square of the domains' number."""
    rng = np.random.default_rng(3)
    size, n = 20, 4_000
    parts = np.zeros((n, size), int)
    for row in parts:
        at = rng.choice(size, rng.integers(1, 4), replace=False)
        row[at] = rng.multinomial(mx.STEPS, rng.dirichlet(np.ones(len(at))))
    words = rng.integers(1, 500, n)
    members = spark.createDataFrame([(int(w), [int(x) for x in p]) for w, p in zip(words, parts, strict=True)], "n_words long, part array<int>")
    begin = time.perf_counter()
    plan = mx.solve(members, [f"d{i}" for i in range(size)], {f"d{i}": 1.0 + i % 3 for i in range(size)})
    took = time.perf_counter() - begin
    p, t = parts / parts.sum(1, keepdims=True), words.astype(float)
    assert np.allclose(plan.start, p.T @ t)
    rows = members.select("n_words", "part", plan.rate("part").alias("rate")).collect()
    own = np.array([r.rate for r in rows])
    shares = np.array([r.part for r in rows]) / mx.STEPS
    assert np.allclose((shares * np.array([r.n_words for r in rows])[:, None]).T @ own, plan.reached, rtol=1e-4)
    plain = (p * t[:, None]).T @ brute_rates(p, t, plan.targets, 0.0)
    scale = 1 / ((p * t[:, None] * p).sum(0))
    error = lambda x: (scale * (x - plan.targets) ** 2).sum()
    assert error(plan.reached) <= 1.05 * error(plain) + 1e-4 * error(plan.start)
    assert took / max(1, len(plan.steps)) < 5


def test_rounds_do_not_follow_the_shuffle(spark, fitted):
    """The pipeline's finding: each round of the descent ran as many tasks as the shuffle before it had parts, through one more shuffle."""
    docs, _, model = fitted
    conf = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = mx.solve(mx.with_membership(docs, model).select("n_words", "part"), model.domains)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.steps and plan.parts.rdd.getNumPartitions() == 1
    assert "Exchange" not in plan.parts.agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()


def test_the_model_is_few_literals(spark, fitted):
    """The pipeline's finding: a literal for each bucket went through the planner, on the driver, again and again."""
    docs, _, model = fitted
    analyzed = mx.with_membership(docs, model)._jdf.queryExecution().analyzed()
    assert analyzed.toJSON().count("catalyst.expressions.Literal") < 1_000
