"""Packing documents into sequences of tokens by a grouping genetic algorithm on islands.

A document's ids end with one mark; only what is longer than a sequence is cut, so that every piece but the first is a
whole sequence. Pieces that fill a sequence stand alone; the others are packed:

* They are ranked by length (ranges sorted apart, no task sees them all) and dealt out in turn to regions of
  REGION_ITEMS, so that all regions have the same mix of lengths, and one is about as hard to pack as the whole.
* A region is packed on ISLANDS islands, each a row of Spark's. An individual is a packing, its genes are whole bins.
  Crossover injects well-filled bins of one parent into the other, takes out the bins that hold an injected document a
  second time, lets displaced documents replace smaller ones where that fills a bin better, and puts the rest into
  the fullest bins that have room (best fit, longest first). An epoch is one
  job over all islands of all regions; between epochs the best of each island goes to the next one. An island rests once
  it has reached the lower bound of its region.
* The emptier bins of all regions are dealt out and packed again in rounds, as long as that saves bins, until one region holds them.

Defined cases: null text is empty and has one token, the mark; repeated rows are packed each on its own; an empty table gives an
empty table; ids of any type are carried along; other columns are ignored. All is seeded by region, island and epoch, so a task
that runs again after a loss gives the same rows.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm.bpe import codec
from verbatlas.llm.rows import named
from verbatlas.session import ship, stash, table

CAPACITY, END_ID = 1_024, 2
#: Pieces of a region, islands of a region, individuals of an island, crossovers in an epoch, and epochs.
REGION_ITEMS, ISLANDS, POPULATION, CROSSOVERS, EPOCHS = 2_048, 3, 4, 24, 2
#: Bins of less than this share of the capacity are packed again with those of other regions.
LOOSE = 0.97
#: Characters up to which a text is encoded in one piece, and pieces that a worker hands on at once.
LEAF_CHARS, FLUSH_PIECES = 16_384, 20_000
_ENCODERS: dict[str, Ids] = {}


# -- ids ------------------------------------------------------------------------------------------
class Ids:
    """Ids of whole texts as bytes (little-endian, 32 bits each), as the tokenizer's file has them.

    The file's vocabulary is also there as ranks, by which ordinary text is encoded some five times faster, to the same ids. Texts
    with one of the file's added tokens, or with characters whose class may differ between versions of Unicode, go
    through the file's own library.
    """

    _ODD = re.compile("[^\x00-\u024f\u0370-\u03ff\u0410-\u044f\u2010-\u2027\u3000-\u3003\u4e00-\u9fa5\uff01-\uff0f\uff1a\uff1b\uff1f]")

    def __init__(self, path: str, ranks: str, pattern: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._ranks = codec(ranks, pattern, LEAF_CHARS)

    def __call__(self, text: str) -> bytes:
        if self._ODD.search(text) or any(x in text for x in self._added):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self._ranks.encode(text), "<u4").tobytes()


def encoder(path: str) -> Ids:
    """One encoder for each Python worker. A path without a folder names a file of the public tokenizers; the ranks lie beside it."""
    if path not in _ENCODERS:
        import public_tokenizers

        found = path if os.path.dirname(path) else public_tokenizers.path(path)
        _ENCODERS[path] = Ids(found, path.removesuffix(".json") + ".tiktoken", public_tokenizers.PATTERN)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of each document's pieces."""
    ship(docs.sparkSession)
    narrow = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    mark = np.array([END_ID], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for at, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py()) + mark
                n = len(ids) // 4
                start, end, k = 0, n % capacity or capacity, 0
                while start < n:
                    rows.append((at, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end, k = end, end + capacity, k + 1
                if len(rows) >= FLUSH_PIECES or at == batch.num_rows - 1:
                    where, *columns = zip(*rows, strict=True)
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "piece", "start", "length", "ids_crc32"])
                    rows = []

    return narrow.mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long")


# -- packing one region ---------------------------------------------------------------------------
def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: large pieces cannot share a bin, and small ones fill what is left beside them."""
    count = np.bincount(np.array(sizes, np.int64), minlength=capacity + 1)
    mass = count * np.arange(capacity + 1)
    n, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(mass)])
    k = np.arange(capacity // 2 + 1)
    alone = n[-1] - n[capacity - k + 1]
    half = capacity // 2 + 1
    large, large_mass = n[capacity - k + 1] - n[half], s[capacity - k + 1] - s[half]
    more = np.maximum(0, -(-(s[half] - s[k] - (large * capacity - large_mass)) // capacity))
    return int((alone + large + more).max())


class Packing:
    """Bins of item numbers, with the bytes' worth of room in each."""

    def __init__(self, bins: list[list[int]], rooms: list[int]):
        self.bins, self.rooms = bins, rooms

    @property
    def cost(self) -> tuple[int, int]:
        """Fewer bins first, then rooms gathered in few bins."""
        return len(self.bins), -sum(r * r for r in self.rooms)

    def filled(self, items: list[int], sizes: list[int], capacity: int) -> Packing:
        """With items put into the fullest bins that have room, in the order given; new bins where none has."""
        at: dict[int, list[int]] = {}
        open_ = 0  # bit r is set if some bin has room r
        for b, room in enumerate(self.rooms):
            if room:
                at.setdefault(room, []).append(b)
                open_ |= 1 << room
        bins, rooms = self.bins, self.rooms
        for i in items:
            size = sizes[i]
            fits = open_ >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = at[room].pop()
                if not at[room]:
                    open_ ^= 1 << room
                bins[b].append(i)
            else:
                room, b = capacity, len(bins)
                bins.append([i])
                rooms.append(capacity)
            room -= size
            rooms[b] = room
            if room:
                at.setdefault(room, []).append(b)
                open_ |= 1 << room
        return self

    def crossed(self, other: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
        """A child: well-filled bins of other injected whole, bins of self that repeat their items taken out, the displaced put in place of smaller ones or best-fitted."""
        picked = sorted(rng.sample(range(len(other.bins)), max(1, len(other.bins) // 2)), key=other.rooms.__getitem__)
        picked = picked[: max(1, len(picked) * 3 // 4)]
        injected = {i for b in picked for i in other.bins[b]}
        bins, rooms, displaced = [list(other.bins[b]) for b in picked], [other.rooms[b] for b in picked], []
        worst = sorted(range(len(self.bins)), key=self.rooms.__getitem__)[-2:]  # the emptiest are opened in any case
        for b, own in enumerate(self.bins):
            if b in worst or not injected.isdisjoint(own):
                displaced += [i for i in own if i not in injected]
            else:
                bins.append(list(own))
                rooms.append(self.rooms[b])
        child = Packing(bins, rooms)
        displaced = child._tightened(displaced, sizes)
        displaced.sort(key=lambda i: -sizes[i])
        return child.filled(displaced, sizes, capacity)

    def _tightened(self, displaced: list[int], sizes: list[int]) -> list[int]:
        """Puts a displaced item in place of one or two smaller ones of a bin where that fills the bin better; what is displaced then."""
        free = sorted((sizes[i], i) for i in displaced)
        for b, own in enumerate(self.bins):
            room, best = self.rooms[b], None
            if not room:
                continue
            out = [(x,) for x in own] + [(x, y) for k, x in enumerate(own[:8]) for y in own[k + 1 : 8]]
            for gone in out:
                size = sum(sizes[x] for x in gone)
                k = bisect_right(free, (size + room, len(sizes))) - 1
                if k >= 0 and free[k][0] > size and (best is None or free[k][0] - size > best[0]):
                    best = free[k][0] - size, k, gone
            if best:
                gain, k, gone = best
                own.append(free.pop(k)[1])
                for x in gone:
                    own.remove(x)
                    insort(free, (sizes[x], x))
                self.rooms[b] -= gain
        return [i for _, i in free]

    def numbers(self, n: int) -> list[int]:
        """The bin of each item."""
        out = [0] * n
        for b, own in enumerate(self.bins):
            for i in own:
                out[i] = b
        return out

    @staticmethod
    def of(numbers: list[int], sizes: list[int], capacity: int) -> Packing:
        bins: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
        for i, b in enumerate(numbers):
            bins[b].append(i)
        return Packing(bins, [capacity - sum(sizes[i] for i in own) for own in bins])


def evolved(sizes: list[int], population: list[Packing], capacity: int, rng: random.Random, crossovers: int, wanted: int) -> list[Packing]:
    """The population after so many crossovers, best first; a new one by best fit in noisy order of lengths if there is none."""
    if not population:
        for noise in [0.0, *(rng.uniform(0.02, 0.2) for _ in range(wanted - 1))]:
            order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
            population.append(Packing([], []).filled(order, sizes, capacity))
            if len(population[-1].bins) <= lower_bound(sizes, capacity):
                break
    population = sorted(population, key=lambda p: p.cost)[:wanted]
    least = lower_bound(sizes, capacity)
    for _ in range(crossovers):
        if len(population[0].bins) <= least or len(population) < 2:
            break
        a, b = rng.sample(population, 2)
        population = sorted([*population, a.crossed(b, sizes, capacity, rng)], key=lambda p: p.cost)[:wanted]
    return population


# -- islands --------------------------------------------------------------------------------------
def _epoch(regions: DataFrame, count: int, state: DataFrame | None, capacity: int, islands: int, turn: int, crossovers: int, wanted: int) -> DataFrame:
    """region, island, population after one epoch; the best of the island before comes in. count: of regions."""
    numbers = "array<array<int>>"
    if state is None:
        island = F.explode(F.array(*map(F.lit, range(islands)))).alias("island")
        rows = regions.select("region", "sizes", island).withColumn("population", F.expr(f"cast(array() as {numbers})"))
    else:
        came = state.select("region", ((F.col("island") + 1) % islands).alias("island"), F.slice("population", 1, 1).alias("came"))
        rows = state.join(came, ["region", "island"]).withColumn("population", F.concat("population", "came")).drop("came").join(regions.select("region", "sizes"), "region")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, island, sizes, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = random.Random(f"{region}/{island}/{turn}")
                best = evolved(sizes, [Packing.of(x, sizes, capacity) for x in found], capacity, rng, crossovers, wanted)
                columns = [pa.array([region], pa.int64()), pa.array([island], pa.int32()), pa.array([[p.numbers(len(sizes)) for p in best]], pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["region", "island", "population"])

    # the rows are few and each is a second's work, so their tasks are not left to the bytes that they read
    tasks = min(count * islands, 8 * int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.select("region", "island", "sizes", "population").repartition(tasks, "region", "island")
    return stash(spread.mapInArrow(work, f"region long, island int, population {numbers}"))


def _placed(regions: DataFrame, state: DataFrame, capacity: int, loose: int) -> DataFrame:
    """region, item, size, bin, place (in its bin), loose, by the best of all islands; bins of more than `loose` room are marked."""
    best = state.select("region", F.get("population", F.lit(0)).alias("numbers"), "island").groupBy("region").agg(F.min_by("numbers", F.struct(F.array_max("numbers"), "island")).alias("numbers"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, items, sizes, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, upto = [], [0] * (max(numbers) + 1)
                for size, b in zip(sizes, numbers, strict=True):
                    place.append(upto[b])
                    upto[b] += size
                columns = [pa.array([region] * len(items), pa.int64()), pa.array(items, pa.int64()), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), pa.array(place, pa.int64()), pa.array([capacity - upto[b] > loose for b in numbers])]
                yield pa.RecordBatch.from_arrays(columns, ["region", "item", "size", "bin", "place", "loose"])

    joined = regions.join(best, "region").select("region", "items", "sizes", "numbers")
    return stash(joined.mapInArrow(work, "region long, item long, size long, bin long, place long, loose boolean"))


def dealt(items: DataFrame, region_items: int) -> tuple[DataFrame, int, int]:
    """region, items, sizes: items (item, size) dealt out by their rank in length; the number of regions and of items.

    What comes to the driver is a count for each range, and their number is a setting.
    """
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = stash(items.repartitionByRange(n, "size", "item").sortWithinPartitions("size", "item").withColumn("_at", F.monotonically_increasing_id()))
    part, first, total = F.shiftright("_at", 33).cast("int"), {}, 0
    for r in sorted(ranked.groupBy(part.alias("p")).count().collect()):
        first[r.p], total = total, total + r["count"]
    count = max(1, -(-total // region_items))
    offsets = F.array(*(F.lit(first.get(p, 0)).cast("long") for p in range(max(first, default=0) + 1)))
    rank = F.get(offsets, part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    held = F.array_sort(F.collect_list(F.struct(F.col("size"), F.col("item"))))
    regions = ranked.groupBy((rank % count).alias("region")).agg(held.alias("h"))
    return stash(regions.select("region", F.col("h.item").alias("items"), F.col("h.size").alias("sizes"))), count, total


def packed(
    items: DataFrame, capacity: int = CAPACITY, region_items: int = REGION_ITEMS, islands: int = ISLANDS, population: int = POPULATION, crossovers: int = CROSSOVERS, epochs: int = EPOCHS
) -> DataFrame:
    """item, sequence_id, offset of items (item long, size long of 1 to capacity)."""
    ship(items.sparkSession)
    done, loose_room, turn, before = None, int(capacity * (1 - LOOSE)), 0, None
    while True:
        regions, count, total = dealt(items, region_items)
        state = None
        for epoch in range(epochs):
            state = _epoch(regions, count, state, capacity, islands, epoch, crossovers, population)
        found = _placed(regions, state, capacity, loose_room)
        sequence = (F.lit(turn) * (1 << 56) + F.col("region") * (1 << 20) + F.col("bin")).alias("sequence_id")
        made = found.select("item", "size", sequence, F.col("place").alias("offset"), "loose")
        if before is not None and before.agg(F.count_distinct("sequence_id")).first()[0] <= made.agg(F.count_distinct("sequence_id")).first()[0]:
            made, count = before, 1  # packing them again saved nothing
        left = made.where("loose").count() if count > 1 else 0
        rest = made if left == 0 or 2 * left > total else made.where("not loose")
        done = rest if done is None else done.union(rest)
        if rest is made:
            return done.select("item", "sequence_id", "offset")
        before, turn = made.where("loose"), turn + 1
        items = before.select("item", "size")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document."""
    found = stash(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("item", F.monotonically_increasing_id()))
    places = packed(found.where(F.col("length") < capacity).select("item", F.col("length").alias("size")), capacity, **options)
    whole = found.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = found.join(places, "item").select(*names).union(whole.select(*names))
    return out.withColumnRenamed("id", id_col)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


QUERIES = {"op11_packing": op11_packing}
ORACLE_SQL: dict[str, str] = {}
