"""Compaction: next fit, the cutoff, ranks and digests against plain loops."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from verbatlas.llm import compaction

SCHEMA = "doc_id long, text string, source string"


def plain(rows):
    """The whole plan by plain loops."""
    files = {}
    for doc, text, source in rows:
        h = zlib.crc32(("" if doc is None else str(doc)).encode())
        block, slot = (doc or 0) // 2000, min(h % 8, h // 8 % 8)
        gone = h // 64 % 100 < 9 * ((slot + block) % 8)
        files.setdefault((source or "", block, slot), []).append((doc, text or "", gone))

    def info(keys):
        own = [r for k in keys for r in files[k]]
        size = lambda x: len(x[1].encode())
        live = sorted((r for r in own if not r[2]), key=lambda r: (r[0] is not None, r[0], r[1]))
        text = "".join(f"{'' if r[0] is None else r[0]}:{r[1]}\n" for r in live)
        return len(live), sum(map(size, own)), sum(map(size, live)), hashlib.sha256(text.encode()).hexdigest(), 100 * (len(own) - len(live)) >= 35 * len(own)

    groups, last, held = [], None, 0
    for k in sorted(files):
        _, total, live, _, dirty = info([k])
        if not (dirty or 4 * total < 3 * 65536):
            continue
        if last != k[0] or held + live > 65536:
            groups.append([])
            last, held = k[0], 0
        groups[-1].append(k)
        held += live
    queue = sorted((g for g in groups if len(g) > 1 or info(g)[4]), key=lambda g: (-len(g), info(g)[1], g[0]))
    whole, so_far, done, out = sum(info(g)[1] for g in queue), 0, set(), []
    for i, g in enumerate(queue):
        live_rows, total, live, sha, _ = info(g)
        so_far += total
        if 100 * so_far > 70 * whole:
            break
        done |= set(g)
        out.append((*g[0], len(g), live_rows, total, total + live + 4096 * len(g), i // 64, sha))
    for k in files:
        if k not in done:
            live_rows, total, _, sha, _ = info([k])
            out.append((*k, 1, live_rows, total, None, None, sha))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("source", "block", "slot", "n_files", "live_rows", "bytes", "cost", "wave", "live_sha256").collect()), key=repr)


def made(seed, n, longest):
    rng = random.Random(seed)
    ids = [rng.randrange(-9_000, 90_000) for _ in range(n)]
    return [(i, "é" * rng.randrange(longest) if rng.random() < 0.9 else None, rng.choice(["a", "a", "a", "b", "", None, "ü"])) for i in ids]


@pytest.mark.parametrize(("seed", "n", "longest"), [(1, 1500, 6000), (2, 3000, 300), (3, 200, 60_000)])
def test_against_plain(spark, seed, n, longest):
    rows = made(seed, n, longest)
    assert found(compaction.compact(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "x", None), (5, "t", "s"), (5, "t", "s"), (5, "a", "s"), (10**15, "far", "s"), (-1, "", "s"), (7, "y" * 300_000, "long")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("block"), F.lit("z").alias("slot"), F.lit(2).alias("id"), F.lit(0).alias("a.b"))
    assert found(compaction.compact(df)) == plain(rows)


def test_other_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "t", "s")], "`my.id` long, `x.y` string, source string")
    assert compaction.compact(df, "my.id", "source", "x.y").count() == 1
    assert compaction.compact(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_of_maps_is_next_fit(spark):
    """Chunks of one block and pairs of neighbours: many levels; files of no bytes and files beyond the limit among them."""
    rng = random.Random(4)
    rows = [(s, b, t, rng.choice([0, 0, 1, 30, 99, 100, 101, 250])) for s in "ab" for b in range(-20, 60) for t in range(8) if rng.random() < 0.4]
    got = compaction.next_fit(spark.createDataFrame(rows, "source string, block long, slot long, live_bytes long"), 100, 1, 2)
    want, last, held = [], None, 0
    for s, b, t, n in sorted(rows):
        if last is None or last[0] != s or held + n > 100:
            last, held = (s, b, t), 0
        held += n
        want.append((s, b, t, n, *last[1:]))
    assert sorted(map(tuple, got.collect())) == want


def test_maps_compose():
    rng = random.Random(5)
    for _ in range(200):
        runs = [[(0, k, rng.choice([0, 1, 3, 7, 12])) for k in range(rng.randrange(1, 6))] for _ in range(2)]
        a, b, whole = (compaction.Fit.of_files(x, 10) for x in (*runs, runs[0] + runs[1]))
        for held in [*range(25), compaction._CLOSED]:
            assert a.then(b)((held, -1, -1))[0] == b(a((held, -1, -1)))[0] == whole((held, -1, -1))[0]


@pytest.mark.parametrize("pivots", [1, 2, 63])
def test_cutoff(spark, pivots):
    rng = random.Random(6)
    rows = [("s", k, 0, rng.randrange(1, 4), rng.choice([0, 0, 5, 9, 1000])) for k in range(150)]
    queue = spark.createDataFrame(rows, "source string, block long, slot long, n_files long, bytes long")
    order = sorted(rows, key=lambda r: (-r[3], r[4], r[:3]))
    for share in (0, 35, 70, 100):
        want, total = [], 0
        for r in order:
            total += r[4]
            if total > sum(x[4] for x in rows) * share // 100:
                break
            want.append(r)
        got = compaction.within_budget(queue, share, pivots)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        ranks = sorted((r.queue_index, r.block) for r in compaction.queue_ranks(got).collect())
        assert ranks == [(i, r[1]) for i, r in enumerate(want)]
