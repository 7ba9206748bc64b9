"""Packing: the ids of the library, places without gaps, and numbers of bins against bounds and plain best fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.llm import packing

SCHEMA = "doc_id long, text string"
FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(FILE))
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs, library, capacity=1024):
    """Each document's ids in pieces; each sequence without gaps and within its capacity; the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc, text in docs:
        ids = library(text)
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want[doc] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for places in by_sequence.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert 0 < upto <= capacity
    return len(by_sequence)


def test_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, FILE).collect()
    found = check(rows, [(r.doc_id, r.text) for r in docs.collect()], library)
    open_ = [r.length for r in rows if r.length < 1024]
    assert found <= packing.lower_bound(open_, 1024) + sum(r.length == 1024 for r in rows) + 1


def test_odd_texts(spark, library):
    texts = [None, "", " ", "a  b   c \n\n d ", "x" * 5000, "<|endoftext|>", "so <|endoftext|> it  <|endoftext|>", "𐐷 ẞ ﬁ    é漢字、。", "'s 'll don't", "ab " * 4000, "͸  \U0001fae0", "１２ Ⅷ ½"]
    docs = [(k // 2, t) for k, t in enumerate(texts)] + [(None, "x"), (7, "same"), (7, "same")]
    df = spark.createDataFrame(docs, SCHEMA).select("*", F.lit(1).alias("item"), F.lit("s").alias("size"), F.lit(0).alias("region"), F.lit(0).alias("a.b"))
    check(packing.pack(df, FILE).collect(), docs, library)
    check(packing.pack(df, FILE, capacity=3).collect(), docs, library, 3)


def test_empty_table_and_other_names(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), FILE).collect() == []
    df = spark.createDataFrame([("k", "one two"), ("l", None)], "`my.id` string, `my.text` string")
    assert sorted(r["my.id"] for r in packing.pack(df, FILE, id_col="my.id", text_col="my.text").collect()) == ["k", "l"]


def test_many_regions_and_rounds(spark):
    """Small regions: the emptier bins go round again, and few bins are lost against the bound of the whole."""
    rng = random.Random(1)
    sizes = [rng.choice([rng.randrange(1, 100), rng.randrange(30, 60), 51]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    rows = packing.packed(df, 100, region_items=100).collect()
    assert sorted(r.item for r in rows) == list(range(3000))
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, sizes[r.item]))
    for places in held.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, [*places[1:], (sum(n for _, n in places), 0)], strict=True))
        assert sum(n for _, n in places) <= 100
    assert len(held) <= packing.lower_bound(sizes, 100) * 1.01
    again = packing.packed(df.repartition(7), 100, region_items=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_bound():
    rng = random.Random(2)
    for _ in range(300):
        bins = [rng.sample(range(1, 30), 3) for _ in range(rng.randrange(1, 8))]
        sizes = [x for own in bins for x in own]
        capacity = max(sum(own) for own in bins)
        assert -(-sum(sizes) // capacity) <= packing.lower_bound(sizes, capacity) <= len(bins)
    assert packing.lower_bound([6] * 10, 10) == 10 and packing.lower_bound([5] * 10, 10) == 5 and packing.lower_bound([], 10) == 0


def test_crossover_finds_what_best_fit_misses():
    """Triples that fill bins of 1000 exactly: best fit by length leaves bins over, the population closes in on the bound."""
    rng = random.Random(3)
    sizes = []
    for _ in range(40):
        a = rng.randrange(380, 490)
        b = rng.randrange(251, 1000 - a - 250)
        sizes += [a, b, 1000 - a - b]
    start = packing.evolved(sizes, [], 1000, random.Random(4), 0, 6)
    after = packing.evolved(sizes, list(start), 1000, random.Random(5), 400, 6)
    assert after[0].cost < start[0].cost and len(after[0].bins) <= len(start[0].bins)
    for p in after:
        assert sorted(i for own in p.bins for i in own) == list(range(len(sizes)))
        assert p.rooms == [1000 - sum(sizes[i] for i in own) for own in p.bins] and min(p.rooms) >= 0
        assert packing.Packing.of(p.numbers(len(sizes)), sizes, 1000).cost == p.cost
