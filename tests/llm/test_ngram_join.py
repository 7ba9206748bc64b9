import random
import re

import numpy as np
import pyarrow as pa
import pytest

from verbatlas.llm import components
from verbatlas.llm import ngram_join as nj
from verbatlas.llm.components import connected


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [w.lower() for w in words]  # bytes: A-Z only
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """doc_id -> (size, component) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 4 >= 3 * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int")
    return sorted((tuple(r) for r in nj.link_components(df).collect()), key=repr)


def family(rng, vocabulary, size, copies, edits):
    base = [rng.choice(vocabulary) for _ in range(size)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        yield " ".join(w)


def test_shingles_against_python():
    texts = ["A b\tc  D e f", "a B c d E F", None, "", " \n", "x", "x y", "X  y", "é É a b c d", "a b c d e " * 9]
    got = nj.shingle_sets(pa.array(texts))
    want = [shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
            assert (nj.digest(got[i]) == nj.digest(got[j])) == (want[i] == want[j])


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        texts += family(rng, vocabulary, rng.choice([6, 12, 40, 120]), rng.randint(2, 9), rng.choice([1, 2, 5]))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([10, 14, 20, 60]))) for _ in range(25)]
    texts += [None, "", " ", "one two", "One  two", "one", "a b c d", "a b c d e", "a b c d e f", texts[0], texts[0].upper(), texts[1]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows.append(rows[3])
    rows += [(None, texts[0]), (7, "one two")]
    if seed == 1:  # all splits at work
        monkeypatch.setattr(nj, "CHUNK", 3)
        monkeypatch.setattr(nj, "FLUSH_SETS", 11)
    if seed == 2:  # nothing found before the lists, and long lists dealt out
        monkeypatch.setattr(nj, "_cluster_round", lambda sets, column, salt: sets.select(nj.F.col("nid").alias("a"), nj.F.col("nid").alias("b")).limit(0))
        monkeypatch.setattr(components, "LOCAL_LINKS", 0)
        monkeypatch.setattr(nj, "PICKS", 3)
        monkeypatch.setattr(nj, "LIST", 4)
        monkeypatch.setattr(nj, "BLOCK", 3)
    assert run(spark, rows) == brute(rows)


def test_chain_across_the_limit(spark):
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base[:i] + [f"u{j}" for j in range(i)] + base[i:]) for i in range(0, 12, 2)]
    rows = list(enumerate(texts, 100))
    assert run(spark, rows) == brute(rows)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"v{i % 7919}x{i}" for i in range(60_000))
    rows = [(5, long), (2, long + " tail"), (9, "short text of just six words")]
    assert run(spark, rows) == [(2, 59_997, 2), (5, 59_996, 2), (9, 2, 9)]
    assert nj.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cluster_finds_components():
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 400)
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 400, 20)), rng.integers(-(2**62), 2**62, 10)])) for _ in range(60)]
    sets += [np.unique(rng.integers(-(2**62), 2**62, 50)) for _ in range(10)]
    seen = {0}
    pairs = nj.cluster(sets)
    assert all(nj.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])) for a, b in pairs)
    for _ in range(60):
        seen |= {x for p in pairs for x in p if seen & set(p)}
    assert seen == set(range(60))


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    long = " ".join(f"a{i}" for i in range(80))
    rows = [(3, long), (1, long + " b"), (9, None), (9, None), (8, ""), (5, "x y z"), (5, "x y z"), (5, long), (6, "X Y z"), (None, "p q"), (7, "unlike all others in here yes")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, root int")
    kept = nj.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, long + " b"), (9, None), (9, None), (8, ""), (5, "x y z"), (None, "p q"), (7, rows[-1][1])], key=repr)
    assert nj.keep_one(df.limit(0)).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for size, change in ((20, 4), (200, 60), (3000, 900)):
        a = np.unique(rng.integers(-(2**62), 2**62, size))
        b = np.unique(np.concatenate([a[change:], rng.integers(-(2**62), 2**62, change)]))
        x, y = (np.frombuffer(nj.sketch(s), np.uint64) for s in (a, b))
        assert len(x) * 64 == nj.SKETCH
        apart = int(np.bitwise_count(x ^ y).sum())
        assert apart <= len(np.setxor1d(a, b)) and (size > 200 or apart > 0.7 * len(np.setxor1d(a, b)))


def dense_group(rng, sets, size, edits):
    """Texts that share a base which is not among them: most pairs come close to the limit, few reach it."""
    base = [f"b{i}" for i in range(size)]
    for k in range(sets):
        w = list(base)
        for j, at in enumerate(rng.sample(range(size), edits)):
            w[at] = f"c{k}x{j}"
        yield " ".join(w)


def test_dense_group_makes_no_pairs(spark, monkeypatch):
    made = []
    for name in ("_open_sets", "_verified", "_pairs"):

        def counted(*args, plain=getattr(nj, name), name=name):
            out = nj.stash(plain(*args))
            made.append((name, out.count()))
            return out

        monkeypatch.setattr(nj, name, counted)
    texts = list(dense_group(random.Random(4), 5_000, 60, 3))
    got = run(spark, list(enumerate(texts)))
    vocabulary = {}
    sets = [[vocabulary.setdefault(s, len(vocabulary)) for s in shingles(t)] for t in texts]
    width = np.bincount(np.concatenate(sets)) > 1  # a shingle of one text alone is in no intersection
    place = np.cumsum(width) - 1
    held = np.zeros((len(texts), int(width.sum())), np.float32)
    for i, s in enumerate(sets):
        s = np.array(s)
        held[i, place[s[width[s]]]] = 1
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(texts))
    linked = 0
    for lo in range(0, len(texts), 500):
        common = held[lo : lo + 500] @ held.T
        a, b = np.nonzero(nj.linked(common, sizes[lo : lo + 500, None], sizes[None, :]))
        linked += len(a)
        for x, y in zip(a + lo, b, strict=True):
            if root[x] != root[y]:
                root[root == max(root[x], root[y])] = min(root[x], root[y])
    assert got == sorted(((i, int(sizes[i]), int(root[i])) for i in range(len(texts))), key=repr)
    assert linked > 100 * len(texts) or len(set(root.tolist())) > len(texts) // 2
    assert made and max(n for _, n in made) <= 40 * len(texts), made  # a set has 14 entries at most; pairs are 12 million


def test_cluster_is_exact():
    rng = random.Random(3)
    for seed in range(6):
        texts = list(dense_group(rng, 60, 50, 3 + seed % 3)) + list(family(rng, [f"w{i}" for i in range(90)], 40, 20, 5))
        sets = nj.shingle_sets(pa.array(texts))
        comp = np.array([rng.randrange(60) for _ in sets]) if seed % 2 else np.arange(len(sets))
        side = np.array([rng.randrange(2) for _ in sets]) if seed > 3 else None
        pairs = nj.cluster(sets, comp, side)
        assert len(pairs) < len(sets)
        size = [len(s) for s in sets]
        links = {(a, b) for a in range(len(sets)) for b in range(a) if nj.linked(len(np.intersect1d(sets[a], sets[b])), size[a], size[b]) and (side is None or side[a] != side[b])}
        assert all((max(p), min(p)) in links for p in pairs)

        def parts(edges, comp=comp):
            root = comp.copy()
            for a, b in edges:
                root[root == root[a]] = root[b]
            return {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())}

        assert parts(pairs) == parts(links)


def test_large_bucket_is_read_in_ranges(spark, monkeypatch):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, [f"w{i}" for i in range(300)], 70, 40, 6)))
    monkeypatch.setattr(nj, "SLICE", 5)
    monkeypatch.setattr(nj, "FLUSH_SETS", 7)
    assert run(spark, rows) == brute(rows)


def test_wide_keys_meet_once(spark):
    rng = random.Random(2)
    rows = [(key, rng.randrange(1, 4) if rng.random() < 0.3 else 7, i) for i, key in enumerate([5] * 60 + [6] * 9 + [8])]
    df = spark.createDataFrame(rows, "h long, comp long, nid long").withColumn("one", nj.F.lit(1))
    dealt = nj._dealt(df, "h", nj._wide(df, "h", "one", 8)).collect()
    places = {}
    for r in dealt:
        places.setdefault((r.h, r.i, r.j), []).append(r)
    met = {}
    for (h, i, j), members in places.items():
        for a in members:
            for b in members:
                if a.nid < b.nid and a.comp != b.comp and (i == j or a.side != b.side):
                    met[h, a.nid, b.nid] = met.get((h, a.nid, b.nid), 0) + 1
    want = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and a[1] != b[1]}
    assert set(met) == want and set(met.values()) <= {1}
    assert max(len(m) for m in places.values()) <= 30 and len(dealt) < 60 * 8


def test_clashing_names(spark):
    names = ["doc_id", "text", "row", "id", "key", "full", "_id", "_text_key", "_key", "chosen_id", "nid", "a.b", "root"]
    rows = [(1, "a b c d e f", *range(11)), (2, "a b c d e f", *range(11)), (3, None, *range(11))]
    kept = nj.keep_one(spark.createDataFrame(rows, names))
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
