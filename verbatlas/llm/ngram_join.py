"""Exact similarity join of word-shingle sets at a Jaccard similarity of 0.75, down to components.

The method is set-relation skipping. Inverted lists are read in blocks ordered by size and position, and
a block is skipped when its sizes or its first position rule out a link. A set's answers are derived from
those of a very similar set: with the overlaps of X known, the overlap of Y with Z is that of X with Z,
less the part of X - Y in Z, plus the part of Y - X in Z, and pairs out of reach are skipped unseen.

Steps, none of which drops a link:

1. Equal sets are one node. One pass over the texts hashes the shingles and counts, for each set, how
   many of its shingles occur in another set. For that each task sends every distinct shingle once, in
   compact blocks; a shingle costs at most an entry for each task, however common it is.
2. A set with more than a quarter of its shingles in no other set has no link: it is done. The shingles
   of the others are read again (`candidates`).
3. Dense groups collapse first: sets with an equal smallest hash meet in chunks of bounded size, and are
   clustered there with the skipping above.
4. What is still missing can only lie between the components found. Prefixes of the sets, in the order of
   how many sets hold a shingle, meet in inverted lists, of shingles that two components share. Long
   lists are dealt out as pairs of blocks. A list does not give pairs but marks the sets that may have a
   link, and the clusters that these make up; in a cluster the sets themselves are compared, as in 3.
   So there are never more rows than sets or entries, however dense a group is.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. Shingles are 64-bit hashes. Equal sets
are found by 128 bits; a set is then known by 64 of them, so that among 10^10 different sets about three
pairs are expected to be taken for one.

Defined cases: null text, or text without words: empty set, linked with nothing, a component of its own;
fewer than five words: one shingle, the whole sequence; repeated rows and equal texts share a component;
rows with null doc_id take part, and a component's id is its smallest known doc_id; an empty table gives
an empty table; extra columns, whatever their names, are ignored (op2) or passed through (keep_one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm.components import connected
from verbatlas.llm.rows import ROW, named, whole_row
from verbatlas.llm.words import mix, release, slices, word_hashes
from verbatlas.session import ship, stash, table

SIZE = 5
#: Shingles and sets that a task gathers before it sends them on.
FLUSH_TOKENS, FLUSH_SETS = 1_000_000, 60_000
#: Buckets of the count: their logarithm at most. A batch grows with them, to hold BLOCK_TOKENS shingles for each.
MOST_LOG, BLOCK_TOKENS = 18, 16
#: Shingles of a bucket that are decoded at once.
SLICE = 2_000_000
#: Bits of a shingle's hash that the count uses beyond those that would just tell all shingles apart. A
#: collision makes a shingle look shared, which costs a little time and no link.
SPARE_BITS = 5
#: Rows of a narrow table (two numbers) up to which it is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
MANY = 65_535
#: Sets and shingles of a chunk in step 3 (about: a longer text is a chunk by itself), and rounds.
CHUNK, CHUNK_TOKENS, ROUNDS = 2_048, 1_000_000, 2
#: Entries of an inverted list that are read at once; longer lists are dealt out as pairs of blocks.
LIST = 4_096
#: Entries of a block that is skipped or read.
BLOCK = 64
#: Rounds in which components are joined by single pairs before all pairs are looked at.
PICKS = 1
#: Sets whose marks a task holds at once.
HELD = 200_000
#: Bits of a set's sketch: the parity of the shingles in each of so many classes. Two sets differ in at
#: least as many shingles as their sketches differ in bits.
SKETCH = 512
_U = np.uint64


def linked(overlap, size_a, size_b):
    """100 * intersection >= 75 * union, from the sizes."""
    return 7 * overlap >= 3 * (size_a + size_b)


# -- shingles -------------------------------------------------------------------------------------
_Q = [_U(pow(0xC2B2AE3D27D4EB4F, k, 2**64)) for k in range(SIZE)]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles (signed 64-bit hashes) of each text."""
    h, first = word_hashes(texts)
    whole = np.zeros(0, np.int64)
    if len(h) >= SIZE:
        total = h[: len(h) - SIZE + 1] * _Q[0]
        for k in range(1, SIZE):
            total = total + h[k : len(h) - SIZE + 1 + k] * _Q[k]
        whole = mix(total).view(np.int64)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SIZE:
            out.append(np.unique(whole[a : b - SIZE + 1]))
        elif b > a:
            short = (h[a:b] * np.array(_Q[: b - a], _U)).sum(dtype=_U) + _U(b - a)
            out.append(mix(np.array([short], _U) ^ _U(0xA5A5A5A5A5A5A5A5)).view(np.int64))
        else:
            out.append(whole[:0])
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in any order of its members."""
    u = s.view(_U)
    one = mix(mix(u ^ _U(0x9AE16A3B2F90404F)).sum(dtype=_U, keepdims=True) + _U(len(s)))
    two = mix(mix(u + _U(0xB492B66FBE98F273)).sum(dtype=_U, keepdims=True) ^ _U(len(s)))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    at = (mix(s.view(_U) ^ _U(0x2545F4914F6CDD1D)) >> _U(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


class _Gathered:
    """Distinct sets of a task's rows until they are sent on, as rows and as blocks for the count."""

    def __init__(self, buckets_log: int, bits: int):
        self.log, self.bits, self.number = buckets_log, bits, 0
        self.clear()

    def clear(self) -> None:
        self.sets: list[np.ndarray] = []
        self.at: dict[tuple[int, int], int] = {}
        self.rows: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, key, s: np.ndarray) -> None:
        d = digest(s)
        place = None
        if len(s) and d not in self.at:
            place = self.at[d] = len(self.sets)
            self.sets.append(s)
            self.tokens += len(s)
        self.rows.append((doc_id, key, len(s), *d, place))

    def full(self) -> bool:
        return self.tokens >= max(FLUSH_TOKENS, BLOCK_TOKENS << self.log) or len(self.sets) >= FLUSH_SETS or len(self.rows) >= 4 * FLUSH_SETS

    def batches(self, part: int) -> Iterator[list[tuple]]:
        """Rows (doc_id, key, n, d1, d2, batch, place, own, bucket, block): of documents, then of blocks.

        A document's bucket is negative and its batch's own; so both kinds pass one exchange.
        """
        batch = (part << 24) + self.number
        self.number += 1
        own = np.zeros(len(self.sets), np.int64)
        blocks = []
        if self.sets:
            h = (np.concatenate(self.sets).view(_U) >> _U(64 - self.bits)).astype(np.int64)
            of = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.append(first, len(h)))
            many = np.repeat(times > 1, times)
            own = np.bincount(of[many], minlength=len(self.sets))
            h, ref = h[first], np.where(times > 1, MANY, of[first]).astype("<u2")
            rest = self.bits - self.log
            bounds = np.searchsorted(h >> rest, np.arange((1 << self.log) + 1))
            low = h & ((1 << rest) - 1)
            for k in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[k], bounds[k + 1]
                x = low[a:b]
                # byte by byte, the highest first: sorted values make long runs there, that compress well
                planes = [((x >> shift) & 255).astype(np.uint8).tobytes() for shift in range(8 * ((rest - 1) // 8), -1, -8)]
                blocks.append((int(k), b"".join([int(b - a).to_bytes(4, "little"), *planes, ref[a:b].tobytes()])))
        yield [(i, key, n, d1, d2, batch, p, None if p is None else int(own[p]), -1 - batch, None) for i, key, n, d1, d2, p in self.rows]
        for k in range(0, len(blocks), 64):
            yield [(None, None, None, None, None, batch, None, None, bucket, raw) for bucket, raw in blocks[k : k + 64]]
        self.clear()


_SCAN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("batch", pa.int64()), ("place", pa.int32()), ("own", pa.int64()), ("bucket", pa.int64()), ("block", pa.binary())])


def _scan(docs: DataFrame, buckets_log: int, bits: int) -> DataFrame:
    """A row for each document, and blocks of shingles for the count; one pass over the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        gathered = _Gathered(buckets_log, bits)

        def out() -> Iterator[pa.RecordBatch]:
            for rows in gathered.batches(context.partitionId() if context else 0):
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCAN, strict=True)], schema=_SCAN)

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids, keys = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 2))
                for i, key, s in zip(ids, keys, shingle_sets(batch.column(1).slice(lo, hi - lo)), strict=True):
                    gathered.add(i, key, s)
                    if gathered.full():
                        yield from out()
        yield from out()
        release()

    return docs.mapInArrow(work, "doc_id long, key long, n long, d1 long, d2 long, batch long, place int, own long, bucket long, block binary")


_COUNTED = pa.schema([*list(_SCAN)[:8], ("places", pa.binary()), ("counts", pa.binary())])


def _count_shared(bucket: pa.Table) -> pa.Table:
    """Of one bucket: for each batch, how many of the shingles that it sent for a set another batch sent too.

    Blocks are sorted, so a large bucket is read in ranges of hashes, of about SLICE shingles each. Rows of
    documents pass through.
    """
    if bucket.column("bucket")[0].as_py() < 0:
        nothing = pa.nulls(bucket.num_rows, pa.binary())
        return pa.table([*(bucket.column(f.name) for f in list(_SCAN)[:8]), nothing, nothing], schema=_COUNTED)
    batch = bucket.column("batch").to_numpy()
    raws = [raw.as_buffer() for raw in bucket.column("block")]
    sizes = [int.from_bytes(raw.slice(0, 4).to_pybytes(), "little") for raw in raws]
    tops = [np.frombuffer(raw, np.uint8, n, 4) for raw, n in zip(raws, sizes, strict=True)]  # sorted, as the hashes are
    steps = max(1, min(256, sum(sizes) // SLICE))
    edges = np.arange(steps + 1) * (int(max(t[-1] for t in tops)) + 1) // steps
    keys = np.zeros(0, np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        parts, refs = [], []
        for raw, n, top in zip(raws, sizes, tops, strict=True):
            a, b = np.searchsorted(top, [low, high])
            planes = (raw.size - 4) // n - 2
            x = np.zeros(b - a, np.int64)
            for k in range(planes):
                x = (x << 8) | np.frombuffer(raw, np.uint8, b - a, 4 + k * n + a)
            parts.append(x)
            refs.append(np.frombuffer(raw, np.uint8, 2 * (b - a), 4 + planes * n + 2 * a).view("<u2"))
        src = np.repeat(np.arange(len(batch)), [len(x) for x in parts])
        h, ref = np.concatenate(parts), np.concatenate(refs).astype(np.int64)
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(first, len(h)))
        shared = np.zeros(len(h), bool)
        shared[order] = np.repeat(times > 1, times)
        shared &= ref != MANY
        keys = np.concatenate([keys, (src[shared] << 16) | ref[shared]])
    keys, counts = np.unique(keys, return_counts=True)
    bounds = np.searchsorted(keys >> 16, np.arange(len(batch) + 1))
    has = [k for k in range(len(batch)) if bounds[k + 1] > bounds[k]]
    cut = [slice(bounds[k], bounds[k + 1]) for k in has]
    none = [pa.nulls(len(has), f.type) for f in list(_SCAN)[:8]]
    none[5] = pa.array(batch[has], pa.int64())
    places = pa.array([(keys[c] & 0xFFFF).astype("<u2").tobytes() for c in cut], pa.binary())
    return pa.table([*none, places, pa.array([counts[c].astype("<u4").tobytes() for c in cut], pa.binary())], schema=_COUNTED)


def _sum_shared(table_: pa.Table) -> pa.Table:
    """The counts of one batch, added up over all buckets."""
    total = np.zeros(MANY + 1, np.int64)
    for p, c in zip(table_.column("places"), table_.column("counts"), strict=True):
        total[np.frombuffer(p.as_buffer(), "<u2")] += np.frombuffer(c.as_buffer(), "<u4")
    at = np.flatnonzero(total)
    batch = table_.column("batch")[0].as_py()
    return pa.table({"batch": pa.array(np.full(len(at), batch, np.int64)), "place": pa.array(at.astype(np.int32)), "others": pa.array(total[at])})


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """The logarithm of the buckets for the count and the bits of a hash, from the size that Spark expects of the table."""
    size = min(2**56, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    log = min(MOST_LOG, max(6, (size // 4_000_000).bit_length()))
    return log, min(60, max(log + 16, (size // 4).bit_length() + SPARE_BITS))


def _near(df: DataFrame) -> DataFrame:
    """A narrow written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


# -- step 3: clusters in a chunk ------------------------------------------------------------------
def cluster(sets: list[np.ndarray], comp: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components of the sets: all that any link joins is joined by those returned.

    comp: components known before, which need no link within. side: only pairs of different sides are
    looked at. There is less than one link for each set, however many there are.

    The overlaps of a pivot with all sets come from an index of the chunk. The sets that share half of
    their shingles with it take their answers from the pivot's: sets that the difference to the pivot
    cannot bring up to the limit are skipped, and the others' overlaps follow from the index lists of
    the shingles in which the two differ.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat_ = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat_, kind="stable")
    flat_, owner = flat_[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat_[1:] != flat_[:-1]]))
    times = np.diff(np.append(first, len(flat_)))
    held = first[times > 1]  # a shingle of one set alone is in no overlap
    length, values = times[times > 1], flat_[held]
    at = np.empty(len(flat_), np.int64)
    at[order] = np.repeat(np.where(times > 1, np.cumsum(times > 1) - 1, -1), times)
    own = [x[x >= 0] for x in np.split(at, np.cumsum(sizes)[:-1])]
    common = np.array([len(x) for x in own])
    group = np.arange(n) if comp is None else np.unique(comp, return_inverse=True)[1].reshape(-1)
    out: list[tuple[int, int]] = []
    open_ = np.ones(n, bool)
    if not len(values):
        return out

    def counted(tokens: np.ndarray) -> np.ndarray:
        """How many of the shingles each set holds."""
        k = length[tokens]
        if not len(k):
            return np.zeros(n, np.int64)
        places = np.repeat(held[tokens] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        return np.bincount(owner[places], minlength=n)

    def foreign(x: int) -> np.ndarray:
        """Sets still to be compared with x, of other components."""
        found = open_ & (group != group[x])
        return found if side is None else found & (side != side[x])

    def take(x: int, overlap: np.ndarray, among: np.ndarray) -> None:
        hit = np.flatnonzero(among & linked(overlap, sizes[x], sizes))
        for z in hit:
            if group[z] != group[x]:
                out.append((int(x), int(z)))
                group[group == group[z]] = group[x]

    for x in np.argsort(-sizes, kind="stable"):
        if not open_[x]:
            continue
        open_[x] = False
        among = foreign(x)
        if not among.any():
            continue
        base = counted(own[x])
        take(x, base, among)
        followers = np.flatnonzero(open_ & (2 * base >= np.maximum(sizes, 1)))
        for y in followers[np.argsort(-base[followers], kind="stable")]:
            open_[y] = False
            reach = foreign(y) & linked(np.minimum(np.minimum(base + common[y] - base[y], common), common[y]), sizes[y], sizes)
            if reach.any():
                less, more = np.setdiff1d(own[x], own[y], assume_unique=True), np.setdiff1d(own[y], own[x], assume_unique=True)
                take(y, base - counted(less) + counted(more), reach)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first `keys` (integer) columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        starts = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            key = tuple(k[:, a])
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        offsets = chunk.offsets.to_numpy()
        values = chunk.values.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def _cluster_round(sets: DataFrame, column: str, salt: int) -> DataFrame:
    """Links a, b among the sets that share a smallest hash, in chunks of about CHUNK sets and CHUNK_TOKENS shingles."""
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_TOKENS))
    hot = stash(sets.groupBy(F.col(column).alias("key")).agg(chunks.alias("chunks"), F.count("*").alias("of")).where("chunks > 1 and of > 1").drop("of"))
    few = hot.count() <= 10_000
    rows = sets.select(F.col(column).alias("key"), "nid", "tokens").join(F.broadcast(hot) if few else hot, "key", "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("nid", F.lit(salt)), F.col("chunks")), F.lit(0))
    rows = rows.select("key", chunk.cast("long").alias("chunk"), "nid", "tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            if group.num_rows > 1:
                ids = group.column(2).to_numpy()
                pairs = cluster(_lists(group.column(3)))
                if pairs:
                    a, b = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])
        release()

    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(work, "a long, b long")


# -- step 4: what lies between components ---------------------------------------------------------
def list_pairs(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, side: np.ndarray, crossed: bool, pick: int | None = None, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one inverted list that may link, of different components.

    Entries are ordered by size and position and read in blocks; a block is skipped by its sizes, or when
    its first position leaves too few shingles, or when it lies within the entry's own component.
    crossed: only pairs of entries of different sides. pick: one pair for each entry at most, the first
    (0), the last (1) or one between (2, ...). marks: sketches, a row of 64-bit numbers for each entry;
    pairs whose sketches differ in more bits than linked sets may differ in shingles are left out.
    """
    order = np.lexsort((pos, n))
    if marks is not None:
        marks = marks[order]
    n, pos, comp, side = n[order], pos[order], comp[order], side[order]
    starts = np.arange(0, len(n), BLOCK)
    least_n, most_n = n[starts], n[np.append(starts[1:], len(n)) - 1]
    # the shingles that an entry can still share from its position on, at most, in a block
    left = n - pos
    most_left = np.maximum.reduceat(left, starts)
    least_comp, most_comp = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
    found_a, found_b = [], []
    for i in range(len(n) - 1 if least_comp.min() != most_comp.max() else 0):
        fits = (most_n >= n[i]) & (3 * least_n <= 4 * n[i]) & (starts + BLOCK > i + 1)
        fits &= (least_comp != comp[i]) | (most_comp != comp[i])
        fits &= linked(np.minimum(left[i], most_left), n[i], np.maximum(least_n, n[i]))
        blocks = np.flatnonzero(fits)
        for k in blocks if pick in (None, 0) else blocks[::-1] if pick == 1 else np.roll(blocks, i % max(1, len(blocks))):
            a, b = max(starts[k], i + 1), min(starts[k] + BLOCK, len(n))
            ok = (comp[a:b] != comp[i]) & linked(np.minimum(left[i], left[a:b]), n[i], n[a:b])
            if crossed:
                ok &= side[a:b] != side[i]
            hit = np.flatnonzero(ok) + a
            if marks is not None and len(hit):
                apart = np.bitwise_count(marks[hit] ^ marks[i]).sum(axis=1)
                hit = hit[7 * apart.astype(np.int64) <= n[hit] + n[i]]
            if pick is not None and len(hit):
                hit = hit[[0 if pick == 0 else -1 if pick == 1 else (i * pick) % len(hit)]]
            found_a.append(np.full(len(hit), i))
            found_b.append(hit)
            if pick is not None and len(hit):
                break
    if not found_a:
        return (np.zeros(0, np.int64),) * 2
    return order[np.concatenate(found_a)], order[np.concatenate(found_b)]


def list_spans(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, side: np.ndarray, crossed: bool, marks: np.ndarray, root: np.ndarray, marked: np.ndarray) -> None:
    """Joins, in root, the components of entries of one inverted list that may link, and marks these entries.

    The same pairs are looked at as by list_pairs, but those of which nothing new follows are skipped:
    two marked entries whose components are joined already. So a dense group is read once, not in pairs.
    """
    order = np.lexsort((pos, n))
    n, pos, comp, side, marks = n[order], pos[order], comp[order], side[order], marks[order]
    own_root, own_marked = root[order], marked[order]
    starts = np.arange(0, len(n), BLOCK)
    least_n, most_n = n[starts], n[np.append(starts[1:], len(n)) - 1]
    left = n - pos
    most_left = np.maximum.reduceat(left, starts)
    least_comp, most_comp = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
    stale = True
    for i in range(len(n) - 1 if least_comp.min() != most_comp.max() else 0):
        if stale:
            least_root, most_root = np.minimum.reduceat(own_root, starts), np.maximum.reduceat(own_root, starts)
            all_marked = np.logical_and.reduceat(own_marked, starts)
            stale = False
        fits = (most_n >= n[i]) & (3 * least_n <= 4 * n[i]) & (starts + BLOCK > i + 1)
        fits &= (least_comp != comp[i]) | (most_comp != comp[i])
        if own_marked[i]:
            fits &= ~(all_marked & (least_root == own_root[i]) & (most_root == own_root[i]))
        fits &= linked(np.minimum(left[i], most_left), n[i], np.maximum(least_n, n[i]))
        for k in np.flatnonzero(fits):
            a, b = max(starts[k], i + 1), min(starts[k] + BLOCK, len(n))
            ok = (comp[a:b] != comp[i]) & linked(np.minimum(left[i], left[a:b]), n[i], n[a:b])
            if own_marked[i]:
                ok &= ~(own_marked[a:b] & (own_root[a:b] == own_root[i]))
            if crossed:
                ok &= side[a:b] != side[i]
            hit = np.flatnonzero(ok) + a
            if len(hit):
                apart = np.bitwise_count(marks[hit] ^ marks[i]).sum(axis=1)
                hit = hit[7 * apart.astype(np.int64) <= n[hit] + n[i]]
            if len(hit):
                own_marked[i] = own_marked[hit] = True
                for other in np.unique(own_root[hit]):
                    own_root[own_root == other] = own_root[i]
                stale = True
    root[order], marked[order] = own_root, own_marked


def _list_columns(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """i, j, nid, n, comp, pos, side of the entries, and their sketches."""
    marks = np.frombuffer(b"".join(group.column(8).to_pylist()), np.uint64).reshape(group.num_rows, -1)
    return [group.column(k).to_numpy() for k in range(1, 8)], marks


def _by_list(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")


def _pairs(dealt: DataFrame, pick: int) -> DataFrame:
    """Pairs a, b that may link, by the inverted lists: one for each entry, and for each two components, at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            (i, j, nid, n, comp, pos, side), marks = _list_columns(group)
            a, b = list_pairs(n, pos, comp, side, bool(i[0] != j[0]), pick, marks)
            if not len(a):
                continue
            a, b = np.where(comp[a] < comp[b], a, b), np.where(comp[a] < comp[b], b, a)
            keys = list(zip(comp[a].tolist(), comp[b].tolist(), strict=True))
            new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if len(seen) > 500_000:
                seen = set()
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (comp[a[new]], comp[b[new]], nid[a[new]], nid[b[new]])], ["ca", "cb", "a", "b"])
        release()

    found = _by_list(dealt).mapInArrow(work, "ca long, cb long, a long, b long")
    return found.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("x")).select("ca", "cb", "x.a", "x.b")


def _open_sets(dealt: DataFrame) -> DataFrame:
    """nid, comp, root: the sets that may still have a link to another component, and a component joined with theirs.

    A task gives a row for each set that it marks, so no more rows than entries.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: dict[int, int] = {}
        comps: dict[int, int] = {}  # of marked sets

        def find(x: int) -> int:
            while roots.setdefault(x, x) != x:
                roots[x] = x = roots[roots[x]]
            return x

        def out() -> Iterator[pa.RecordBatch]:
            if comps:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (comps.keys(), comps.values(), map(find, comps.values()))], ["nid", "comp", "root"])

        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            (i, j, nid, n, comp, pos, side), marks = _list_columns(group)
            root = np.array([find(c) for c in comp.tolist()], np.int64)
            before = root.copy()
            marked = np.array([x in comps for x in nid.tolist()])
            list_spans(n, pos, comp, side, bool(i[0] != j[0]), marks, root, marked)
            for c, r in set(zip(before.tolist(), root.tolist(), strict=True)):
                roots[find(c)] = find(r)
            comps.update(zip(nid[marked].tolist(), comp[marked].tolist(), strict=True))
            if len(comps) > HELD:
                yield from out()
                roots, comps = {}, {}
        yield from out()
        release()

    return _by_list(dealt).mapInArrow(work, "nid long, comp long, root long")


def _dealt(rows: DataFrame, key: str, wide: DataFrame) -> DataFrame:
    """rows (with key, comp, nid) with i, j, side: where the rows of a key meet.

    wide: key, major, majors, minors for the keys that are too large for one place: the component with
    the most rows, in how many blocks those are dealt out, and the others. Every two rows of a key with
    different components meet in one place: a row of another component goes to all blocks, a row of the
    major one only to those of the others, so that a key that one component holds costs no square.
    """
    if not wide.count():
        return rows.select("*", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("side"))
    wide = wide.select(F.col(key).alias("_key"), "major", "majors", "minors")
    joined = rows.join(_near(wide), F.col(key) == F.col("_key"), "left")
    major = F.coalesce(F.col("comp") == F.col("major"), F.lit(False))
    minors, majors = (F.coalesce(F.col(c), F.lit(1)).cast("long") for c in ("minors", "majors"))
    total = F.when(F.col("major").isNull(), F.lit(1).cast("long")).otherwise(minors + majors)
    side = F.when(F.col("major").isNull(), F.lit(0).cast("long")).otherwise(F.when(major, minors + F.pmod(F.xxhash64("nid"), majors)).otherwise(F.pmod(F.xxhash64("nid"), minors)))
    places = joined.withColumn("side", side).withColumn("_upto", F.when(major, minors).otherwise(total)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_upto") - 1)))
    return places.withColumns({"i": F.least("side", "_other"), "j": F.greatest("side", "_other")}).drop("_key", "major", "majors", "minors", "_upto", "_other")


def _wide(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """key, major, majors, minors of the keys with more than one place: size is what a row takes of `most`."""
    by = rows.groupBy(key, "comp").agg(F.sum(size).alias("s")).groupBy(key).agg(F.sum("s").alias("s"), F.max(F.struct("s", "comp")).alias("top"))
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / most)).cast("long")
    return stash(by.where(F.col("s") > most).select(key, F.col("top.comp").alias("major"), blocks(F.col("top.s")).alias("majors"), blocks(F.col("s") - F.col("top.s")).alias("minors")))


def _verified(sets: DataFrame, open_: DataFrame) -> DataFrame:
    """Links a, b that join components, among the open sets (nid, comp, cluster): the sets of a cluster meet and are compared there."""
    rows = sets.drop("comp").join(open_, "nid").select("cluster", "comp", "nid", "n", "tokens")
    size = F.greatest(F.lit(CHUNK_TOKENS // CHUNK), F.col("n"))
    wide = _wide(rows.select("cluster", "comp", size.alias("size")), "cluster", "size", CHUNK_TOKENS)
    met = _dealt(rows, "cluster", wide).select("cluster", "i", "j", "side", "comp", "nid", "tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            if group.num_rows > 1:
                _, i, j, side, comp, nid = (group.column(k).to_numpy() for k in range(6))
                pairs = cluster(_lists(group.column(6)), comp, side if i[0] != j[0] else None)
                if pairs:
                    a, b = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([pa.array(nid[a]), pa.array(nid[b])], ["a", "b"])
        release()

    return met.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(work, "a long, b long")


def _between(sets: DataFrame) -> DataFrame:
    """Verified links a, b between components, of sets (nid, n, tokens, sketch, comp).

    Components are joined by one pair each for a few rounds. Only then are all lists read for what may
    still lie between components: not for pairs, but for the sets that take part and the clusters that
    they make up. Within a cluster the sets themselves are compared, and links that span it come out.
    """
    least = lambda n: F.expr(f"{n} - (3 * {n} + 3) div 4 + 1")  # noqa: E731  shingles of a prefix
    # sets whose first shingles, in the order of the hashes, are all within one component are done
    start = sets.select("nid", "comp", F.explode(F.slice("tokens", F.lit(1), least("n").cast("int"))).alias("h"))
    across = lambda df: df.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("h", "c")
    open_ = stash(start.select("h", "nid").join(across(start), "h", "left_semi").select("nid").distinct())
    rest = stash(sets.join(_near(open_), "nid", "left_semi"))
    # prefixes anew, rarest shingles first: those within one component come before all others
    tokens = rest.select("nid", "n", "comp", F.explode("tokens").alias("h"))
    shared = tokens.join(across(tokens), "h").groupBy("nid", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("x"))
    own = F.col("n") - F.size("x")
    entries = stash(
        shared.where(own < least("n"))
        .select("nid", "n", "comp", own.alias("own"), F.posexplode(F.slice("x", F.lit(1), (least("n") - own).cast("int"))).alias("at", "x"))
        .select(F.col("x.h").alias("h"), F.col("x.c").alias("c"), "nid", "n", "comp", (F.col("own") + F.col("at")).alias("pos"))
    )
    long = entries.where(F.col("c") > LIST).withColumn("one", F.lit(1))
    dealt = _dealt(entries, "h", _wide(long, "h", "one", LIST)).select("h", "i", "j", "nid", "n", "pos", "side")
    dealt = stash(dealt.join(rest.select("nid", "sketch"), "nid"))
    x = rest.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = rest.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    with_comp = lambda: dealt.join(_near(comps), "nid").select("h", "i", "j", "nid", "n", "comp", "pos", "side", "sketch")

    comps = stash(rest.select("nid", "comp"))
    found = []
    for pick in range(PICKS):
        links = stash(_pairs(with_comp(), pick).join(x, "a").join(y, "b").where(linked(common, F.col("na"), F.col("nb"))).select("ca", "cb", "a", "b"))
        found.append(links.select("a", "b"))
        if not links.count():
            break
        roots = _near(connected(links, "ca", "cb"))
        comps = stash(comps.join(roots, comps["comp"] == roots["node"], "left").select("nid", F.coalesce("root", "comp").alias("comp")))
    marked = stash(_open_sets(with_comp()).distinct())
    clusters = connected(marked, "comp", "root")
    marked = marked.select("nid", "comp").distinct()
    in_clusters = marked.join(_near(clusters), F.col("comp") == F.col("node")).select("nid", "comp", F.col("root").alias("cluster"))
    out = stash(_verified(rest, stash(in_clusters)))
    for links in found:
        out = out.union(links)
    return out


# -- the operator ---------------------------------------------------------------------------------
def candidates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """nid, n, tokens and smallest hashes of the sets that may have a link; a row for each distinct set.

    rows: doc_id, n, d1, d2, shared. The texts of one document for each such set are read again.
    """
    nodes = rows.where("n > 0").groupBy("d1", "d2").agg(F.max("n").alias("n"), F.max("shared").alias("shared"), F.min("doc_id").alias("doc_id"))
    open_ = nodes.where("n - shared < n - (3 * n + 3) div 4 + 1").select("doc_id", "d1", "d2")
    open_ = stash(open_)
    wanted = _near(open_.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]), "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                made = []
                for s in shingle_sets(batch.column(1).slice(lo, hi - lo)):
                    if len(s):
                        d = digest(s)
                        made.append((*d, len(s), s, sketch(s), *(int(mix(s.view(_U) * _U(2 * r + 3)).min().view(np.int64)) for r in range(ROUNDS))))
                if made:
                    types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary()] + [pa.int64()] * ROUNDS
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], ["d1", "d2", "n", "tokens", "sketch", *(f"k{r}" for r in range(ROUNDS))])
        release()

    sets = texts.select("doc_id", "text").mapInArrow(work, "d1 long, d2 long, n long, tokens array<long>, sketch binary, " + ", ".join(f"k{r} long" for r in range(ROUNDS)))
    # one row for each set: rows with equal doc_id may differ in text, or repeat it
    once = sets.join(_near(open_.select("d1", "d2")), ["d1", "d2"], "left_semi")
    return once.groupBy("d1", "d2").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "sketch", *(f"k{r}" for r in range(ROUNDS))))).withColumnRenamed("d1", "nid").drop("d2")


def text_key(text: Column) -> Column:
    """A number for a row's text, by which rows with one doc_id are told apart."""
    return F.xxhash64(text)


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), n, root for each row of docs. Rows with a root, and n above 0, form its component."""
    ship(docs.sparkSession)
    narrow = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    fields = "doc_id long, key long, n long, d1 long, d2 long, batch long, place int, own long"
    scan = _scan(narrow.withColumn("key", text_key(F.col("text"))), *_sizes(narrow))
    seen = stash(scan.groupBy("bucket").applyInArrow(_count_shared, f"{fields}, places binary, counts binary"))
    counted = seen.where("places is not null").select("batch", "places", "counts").groupBy("batch").applyInArrow(_sum_shared, "batch long, place int, others long")
    rows = seen.where("places is null").drop("places", "counts")
    rows = stash(rows.join(counted, ["batch", "place"], "left").select("doc_id", "key", "n", "d1", "d2", (F.coalesce("own", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("shared")))
    sets = stash(candidates(narrow, rows))
    edges = stash(_cluster_round(sets, "k0", 0).union(_cluster_round(sets, "k1", 1)))
    found = _near(connected(edges))
    placed = sets.join(found, sets["nid"] == found["node"], "left").select("nid", "n", "tokens", "sketch", F.coalesce("root", "nid").alias("comp"))
    late = _between(placed)
    roots = stash(connected(edges.union(late)))
    return rows.join(roots, F.col("d1") == F.col("node"), "left").select("doc_id", "key", "n", F.coalesce("root", "d1").alias("root"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component) for each row of docs."""
    rows = rooted(docs, id_col, text_col)
    full = rows.where("n > 0")
    names = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = full.join(names, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component (that with the smallest doc_id); rows with empty sets stay."""
    rows = stash(rooted(docs, id_col, text_col).withColumn("full", F.col("n") > 0))
    best = rows.where("full").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select("x.doc_id", "x.key", F.lit(True).alias("full"))
    chosen = stash(best.union(rows.where("not full").select("doc_id", "key", "full").distinct()).select(F.col("doc_id").alias("chosen_id"), F.col("key").alias("chosen_key"), "full"))
    near = _near(chosen)
    marked = docs.select(whole_row(), named(id_col).cast("long").alias("id"), text_key(named(text_col)).alias("key"))
    kept = marked.join(near, F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("key") == F.col("chosen_key")))
    repeated = rows.where("full").groupBy("doc_id", "key").count().where("count > 1").limit(1).count()
    if repeated:  # equal rows: one of them stays
        kept = kept.where("full").dropDuplicates(["id", "key"]).union(kept.where("not full"))
    return kept.select(f"{ROW}.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_join": op2_ngram_join}
#: All pairs by their common shingles, and components as what can be reached.
ORACLE_SQL = {
    "op2_ngram_join": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + {SIZE - 1}), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(2, len(w) - {SIZE - 2}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON d.rid = n.rid JOIN r ON r.a = d.rid JOIN d o ON r.b = o.rid GROUP BY d.rid
"""
}
