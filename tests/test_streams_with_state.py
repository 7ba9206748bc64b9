"""Streams with state: eviction, restarts, batches that run again, idle keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbatlas.streaming import stateful


def played(spark, tmp_path, batches, schema, make):
    """What make(stream) puts out when each batch comes after a restart on the same checkpoint."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for batch in batches:
        spark.createDataFrame(batch, schema).repartition(2).write.mode("append").parquet(source)
        make(spark.readStream.schema(schema).parquet(source), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def remembered(rows, window):
    held, out = {}, []
    for place, key, item in rows:
        own = held.setdefault(key, [])
        if item not in own:
            out.append((place, key, item))
            own.append(item)
            if len(own) > window:
                del own[: max(1, window // 10)]
    return out


def test_memory_evicts_a_tenth(spark, tmp_path):
    """A window of 20 forgets two at once; null keys and items are values; odd column names."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", None]), rng.choice([None, *map(str, range(30))])) for i in range(900)]
    make = lambda s, out, at: stateful.append_into(stateful.bounded_unique_stream(s, ["my key"], ["_it.em"], "place", 20), out, at)
    got = played(spark, tmp_path, [rows[:200], rows[200:201], rows[201:]], "place long, `my key` string, `_it.em` string", make)
    assert sorted((r[0], r[1], r[2]) for r in got.drop("batch").collect()) == remembered(rows, 20)


def test_running_count_goes_on(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "x", "y", None])) for i in range(300)]
    make = lambda s, out, at: stateful.append_into(stateful.running_count_stream(s, "v", "i", "n"), out, at)
    got = played(spark, tmp_path, [rows[:100], rows[100:110], rows[110:]], "i long, v string", make)
    seen, want = Counter(), []
    for i, v in rows:
        seen[v] += 1
        want.append((i, v, seen[v]))
    assert sorted(tuple(r) for r in got.select("i", "v", "n").collect()) == want


def test_filter_releases_and_retracts(spark, tmp_path):
    """Values that pass late, that grow past the bound, that never pass, nulls and equal rows; a batch that runs again changes nothing."""
    batches = [
        [("late", 1), ("over", 1), ("over", 2), ("once", 1), (None, 1)],
        [("late", 2), ("over", 3), ("same", 7), ("same", 7), (None, 1)],
        [("late", 3), ("over", 4), ("new", 1), ("new", 2)],
    ]
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source = str(tmp_path / "in")
    states = []
    for batch in batches:
        spark.createDataFrame(batch, "v string, k int").write.mode("append").parquet(source)
        stateful.filter_into(spark.readStream.schema("v string, k int").parquet(source), "v", out, at, 2, 3).awaitTermination()
        states.append(sorted(map(tuple, stateful.kept_so_far(spark, out).collect()), key=repr))
    rows, want = [], []
    for batch in batches:
        rows += batch
        n = Counter(v for v, _ in rows)
        want.append(sorted((r for r in rows if 2 <= n[r[0]] <= 3), key=repr))
    assert states == want
    signs = Counter(r.change for r in spark.read.parquet(f"{out}/changes").collect())
    assert signs[-1] == 3  # `over` had three rows out when its fourth came
    again = tmp_path / "checkpoint" / "commits"
    last = max((p for p in again.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    stateful.filter_into(spark.readStream.schema("v string, k int").parquet(source), "v", out, at, 2, 3).awaitTermination()
    assert sorted(map(tuple, stateful.kept_so_far(spark, out).collect()), key=repr) == want[-1]


def test_idle_keys_are_forgotten(spark, tmp_path):
    """Once the watermark is beyond a key's last row and its idle time, its items are new again."""
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    batches = [[(1, "a", "x", day(1))], [(2, "b", "y", day(20))], [(3, "b", "z", day(21))], [(4, "a", "x", day(22)), (5, "b", "y", day(22))]]
    typed = lambda s: s.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", "1 hour")
    make = lambda s, out, at: stateful.append_into(stateful.bounded_unique_stream(typed(s), ["k"], ["item"], "i", 10, "t", 5 * 86_400_000), out, at)
    got = played(spark, tmp_path, batches, "i long, k string, item string, t string", make)
    assert sorted(r.i for r in got.collect()) == [1, 2, 3, 4]


def test_bad_arguments(spark, tmp_path):
    rows = spark.createDataFrame([], "a long")
    with pytest.raises(ValueError):
        stateful.bounded_unique_stream(rows, ["a"], ["a"], "a", 0)
    with pytest.raises(ValueError):
        stateful.bounded_unique_stream(rows, ["a"], ["a"], "a", 5, idle_ms=3)
