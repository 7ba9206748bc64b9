import numpy as np
import pytest

from verbatlas.llm import ann

F = ann.F


def exact(ids, vectors, asked, k=20):
    v = np.array(vectors, np.float32).astype(np.float64)
    ids = np.array(ids)
    out = {}
    for q in asked:
        s = (v * v[q]).sum(axis=1)
        at = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in at]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("kind", ["gauss", "clusters", "norms"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 300)
    rng = np.random.default_rng(4)
    n, dim = 3000, 16
    v = rng.normal(size=(n, dim))
    if kind == "clusters":
        v = rng.normal(size=(30, dim))[rng.integers(0, 30, n)] + 0.1 * v
    if kind == "norms":
        v *= rng.gamma(2, size=(n, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = found(ann.search(df, F.col("vec_id") % 20 == 0))
    want = exact(range(n), v, range(0, n, 20))
    assert recall(got, want) >= 0.9
    for q, rows in got.items():
        s = dict(rows)
        x = v.astype(np.float32).astype(np.float64)
        assert len(rows) == 20 and q not in s
        assert all(abs(s[i] - x[q] @ x[i]) < 1e-9 for i in s)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (20, [0.0, 0.0]), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (3, [2.0, 1.0]), (4, [1.0, 2.0]), (2, [1.0, 2.0]), (100, [1.0]), (120, []), (140, [-1.0, -1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = found(ann.search(df.drop("rank"), F.col("vec_id") % 20 == 0))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [2, 4, 3, 140], 140: [0, 2, 3, 4]}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 8))
    v[rng.permutation(900)[:500]] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got, want = found(ann.search(df, F.col("vec_id") % 20 == 0)), exact(range(900), v, range(0, 900, 20))
    assert recall(got, want) >= 0.9
    hot = [q for q in want if q % 20 == 0 and (v[q] == v[0]).all()]
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in hot)


def test_graph_reaches_all():
    rng = np.random.default_rng(1)
    index = ann.fit(rng.normal(size=(4000, 12)), 4000, 60.0, 20)
    points = index.lifted(rng.normal(size=(50, 12)), True)
    whole = ann._distances(points, index.centroids)
    some = index.search(points, 1.1)
    near = whole <= 1.1 * whole.min(axis=1, keepdims=True)
    assert (np.isfinite(some) & near).sum() >= 0.99 * near.sum()
    assert np.isfinite(index.search(points, np.inf)).all()


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = found(ann.op3_ann(spark, sf))
    want = exact([r.vec_id for r in rows], [r.embedding for r in rows], [i for i, r in enumerate(rows) if r.vec_id % 20 == 0])
    assert set(got) == set(want) and recall(got, want) >= 0.95


def test_wide_search_equals_all():
    """A ratio of infinity gives the exact answer, ties and repeated vectors included."""
    rng = np.random.default_rng(6)
    index = ann.fit(rng.normal(size=(9000, 10)), 60_000, 60.0, 20)
    points = index.lifted(rng.normal(size=(70, 10)), True)
    node, dist = index.nearest(points, np.inf)
    assert (np.sort(node, axis=1) == np.arange(len(index.centroids))).all()
    assert (np.diff(dist, axis=1) >= 0).all()
    assert np.allclose(np.take_along_axis(ann._distances(points, index.centroids), node, axis=1), dist)
    few, _ = index.nearest(points, 1.0, least=1)
    assert few.shape[1] < len(index.centroids)  # the work follows what is selected


def test_exact_mode(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(1500, 6)), 1)
    v[700:760] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = found(ann.search(df, F.col("vec_id") % 20 == 0, ratio=float("inf")))
    assert got == exact(range(1500), v, range(0, 1500, 20))


def test_lists_follow_the_table():
    assert [ann.wanted_lists(n) for n in (1, 2, 100, 60_000, 10**6, 10**8)] == [1, 2, 16, 256, 1024, ann.MOST_LISTS]
