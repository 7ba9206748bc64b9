"""Source divergence: whole audits and ranks against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verbatlas.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, top=200, least=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(lower) for t in PATTERN.findall(text or "")]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
        total[lang].update(terms)
    out = []
    for lang, source in counts:
        kept = [t for t in held[lang] if held[lang][t] >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        own, whole = p(counts[lang, source]), p(total[lang])
        f = lambda a, b: (a - b) ** 2 // b
        pairs = []
        for other_lang, other in counts:
            if other_lang == lang and other != source:
                q = p(counts[lang, other])
                pairs.append((-sum(f(own[t], q[t]) for t in kept), other.encode(), other))
        found = [(-f(own[t], whole[t]), t.encode(), t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1)]
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def made(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "aB", "né", "NÉ", "x-y", "z9z", "漢字", "ß"] + ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4))) for _ in range(80)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
    return [(i, text() if rng.random() < 0.95 else None, rng.choice(["l", "l", "m", None]), rng.choice(["a", "a", "a", "b", "c", "", None])) for i in range(n)]


@pytest.mark.parametrize(("seed", "top", "direct"), [(1, 200, 4096), (2, 5, 1)])
def test_against_plain(spark, monkeypatch, seed, top, direct):
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 3)
    rows = made(seed, 120)
    assert found(spark.createDataFrame(rows, SCHEMA), top=top, direct=direct) == plain(rows, top)


def test_odd_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "l", "s"), (3, "only once", "l", "t"), (4, "w " * 50_000, "m", "s"), (5, "w", "m", "s"), (6, "w W", "m", "t"), (7, "123 .,", "m", "u")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("term"), F.lit(1).alias("n"), F.lit(1).alias("a.b"))
    assert found(df) == plain(rows)


def test_other_names(spark):
    rows = made(3, 40)
    df = spark.createDataFrame([r[1:] for r in rows], "`my.text` string, `my.lang` string, `my.source` string")
    assert found(df, text_col="my.text", lang_col="my.lang", source_col="my.source") == plain(rows)


def test_ranks_of_ties_and_large_values(spark):
    """Every level of digits: values that differ in the last bit only, and equal values with texts that differ late."""
    rng = random.Random(7)
    values = [0, 1, 2, 2047, 2048, 2**40, 2**62, 2**62 + 1, 2**62 + 2, 2**63 - 1]
    rows = [(g, rng.choice(values), "é" * rng.randrange(4) + rng.choice("ab") * rng.randrange(5) + str(i % 7)) for i in range(400) for g in (1, 2)]
    rows += [(3, 5, "same")] * 20 + [(4, 9, "one")]
    df = spark.createDataFrame(rows, "g long, v long, t string")
    for k, direct in ((1, 1), (37, 1), (37, 50), (1000, 10)):
        got = sorted((r.g, r["rank"], r.v, r.t) for r in divergence.first_ranks(df, ["g"], "v", "t", k, direct).collect())
        want = [(g, i, v, t) for g in (1, 2, 3, 4) for i, (v, t) in enumerate(sorted(((v, t) for x, v, t in rows if x == g), key=lambda r: (-r[0], r[1].encode()))[:k], 1)]
        assert got == want, (k, direct)


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13), (8 * 10**9, 10**10), (0, 7)], "n long, whole long")
    got = [r[0] for r in df.select(divergence._scaled(F.col("n"), F.col("whole"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // w for n, w in ((10**13, 3 * 10**13), (8 * 10**9, 10**10), (0, 7))]
