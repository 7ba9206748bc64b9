"""A plan for compacting small files, and the digests of what the rewritten files will hold.

Rows lie in files (source, block, slot) that follow from their ids. Files that are small or hold many deleted rows
are grouped by next fit in the order of their source; groups queue by a composite key, and the longest prefix of the
queue that a budget of bytes allows is rewritten. Nothing that grows with the table goes through one task:

* Next fit looks sequential, but a run of files maps the bytes in the open group before it to the bytes in the open
  group behind it: below a threshold it adds its bytes, above it the exit depends on the place of the first cut only. Such maps
  compose, so files are cut into chunks of CHUNK_BLOCKS blocks (at most 8 files a block), the maps of FAN neighbours
  are composed up a tree, and entries are handed down it again. A map has at most as many steps as the limit has bytes.
* The budget's cutoff is found by a weighted quickselect: each round draws PIVOTS keys by hash, sums the bytes between
  them, and goes on in the one interval that the cutoff lies in, until that interval is a single group.
* Only the prefix is ranked: it is cut into ranges of the key, whose counts give the first index of each.
* Contents are hashed as a stream in the order of the ids: a task holds one batch of rows, however large a file is.

Defined cases: null source or text counts as empty; a null id is an empty text in digests and hash, and lies in block
0; rows with one id lie in one file and are hashed in the order of their texts; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm.rows import named
from verbatlas.session import ship, stash, table

BLOCK_ROWS = 2_000
#: Files are dirty from this share of deleted rows on (per cent), and small below three quarters of TARGET_BYTES.
DIRTY_SHARE, TARGET_BYTES = 35, 65_536
#: Per cent of the queue's bytes that are rewritten; groups of a wave; cost of opening a file in bytes.
BUDGET_SHARE, WAVE, FILE_COST = 70, 64, 4_096
#: Blocks of a chunk and neighbours composed at once.
CHUNK_BLOCKS, FAN = 16, 64
#: Keys drawn in a round of the quickselect.
PIVOTS = 63
#: More than any sum of bytes: no group is open yet.
_CLOSED = 1 << 62
_FILE = ("source", "block", "slot")


# -- files ----------------------------------------------------------------------------------------
def located(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, text, and the file of each row: block and slot; and whether the row is deleted."""
    rows = docs.select(
        named(id_col).cast("long").alias("id"), F.coalesce(named(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(named(text_col), F.lit("")).alias("text")
    )
    place, h = F.coalesce("id", F.lit(0)), F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    block = F.expr(f"coalesce(id, 0L) div {BLOCK_ROWS}") - (place % BLOCK_ROWS < 0).cast("long")
    rows = rows.select("*", block.alias("block"), h.alias("h")).withColumn("slot", F.least(F.col("h") % 8, F.expr("h div 8") % 8))
    gone = F.expr("h div 64") % 100 < 9 * F.pmod(F.col("slot") + F.col("block"), F.lit(8))
    return rows.select("id", "source", "text", "block", "slot", gone.alias("deleted"))


def files(rows: DataFrame) -> DataFrame:
    """A row for each file: rows, live rows, bytes, live bytes, and whether it is dirty, and picked for grouping."""
    size = F.octet_length("text").cast("long")
    out = rows.groupBy(*_FILE).agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(~F.col("deleted"), 1)).alias("live_rows"),
        F.sum(size).alias("bytes"),
        F.sum(F.when(F.col("deleted"), 0).otherwise(size)).alias("live_bytes"),
    )
    dirty = 100 * (F.col("n_rows") - F.col("live_rows")) >= DIRTY_SHARE * F.col("n_rows")
    return out.withColumn("dirty", dirty).withColumn("picked", F.col("dirty") | (4 * F.col("bytes") < 3 * TARGET_BYTES))


# -- next fit as a tree of maps -------------------------------------------------------------------
class Fit:
    """What a run of files does to the group open before it.

    The state is (bytes, block, slot): the bytes in the open group and its first file. Up to `lows[0]` bytes the run
    fits and adds `total`; a state of more than lows[k] and at most lows[k + 1] bytes leaves as exits[k].
    """

    def __init__(self, total: int, lows: list[int], exits: list[tuple[int, int, int]]):
        self.total, self.lows, self.exits = total, lows, exits

    @staticmethod
    def of_files(found: list[tuple[int, int, int]], limit: int) -> Fit:
        """The map of files (block, slot, bytes) in order."""
        ends = np.cumsum([x[2] for x in found])
        before = np.concatenate([[0], ends[:-1]])
        after = np.maximum(np.searchsorted(ends, before + limit, "right"), np.arange(1, len(found) + 1))
        left: list[tuple[int, int, int]] = [(0, 0, 0)] * len(found)
        for j in range(len(found) - 1, -1, -1):
            left[j] = left[after[j]] if after[j] < len(found) else (int(ends[-1] - before[j]), found[j][0], found[j][1])
        starts = [j for j in range(len(found) - 1, -1, -1) if j == 0 or ends[j] > ends[j - 1]]
        return Fit(int(ends[-1]), [limit - int(ends[j]) for j in starts], [left[j] for j in starts]).slim()

    def slim(self) -> Fit:
        """The same map without steps that change nothing."""
        keep = [k for k in range(len(self.lows)) if k == 0 or self.exits[k] != self.exits[k - 1]]
        return Fit(self.total, [self.lows[k] for k in keep], [self.exits[k] for k in keep])

    def __call__(self, state: tuple[int, int, int]) -> tuple[int, int, int]:
        k = bisect_left(self.lows, state[0])
        return self.exits[k - 1] if k else (state[0] + self.total, state[1], state[2])

    def then(self, other: Fit) -> Fit:
        through = [(low - self.total, end) for low, end in zip(other.lows, other.exits, strict=True) if low - self.total < self.lows[0]]
        return Fit(self.total + other.total, [x[0] for x in through] + self.lows, [x[1] for x in through] + [other(x) for x in self.exits]).slim()


_MAP = "total long, lows array<long>, exits array<struct<sum: long, block: long, slot: long>>"
_MAP_TYPE = pa.struct([("total", pa.int64()), ("lows", pa.list_(pa.int64())), ("exits", pa.list_(pa.struct([("sum", pa.int64()), ("block", pa.int64()), ("slot", pa.int64())])))])


def _fit(x: dict) -> Fit:
    return Fit(x["total"], x["lows"], [(e["sum"], e["block"], e["slot"]) for e in x["exits"]])


def _as_row(fit: Fit) -> dict:
    return {"total": fit.total, "lows": fit.lows, "exits": [dict(zip(("sum", "block", "slot"), e, strict=True)) for e in fit.exits]}


def _with_maps(df: DataFrame, make) -> DataFrame:
    """source, node and map of rows (source, node, parts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_as_row(make(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, _MAP_TYPE)], ["source", "node", "map"])

    return df.select("source", "node", "parts").mapInArrow(work, f"source string, node long, map struct<{_MAP}>")


def next_fit(picked: DataFrame, limit: int = TARGET_BYTES, chunk_blocks: int = CHUNK_BLOCKS, fan: int = FAN) -> DataFrame:
    """picked (source, block, slot, live_bytes and others, one row for each file) with first_block, first_slot: the first file of its group.

    Files of a source come in the order of block and slot; a file joins the last group, or starts another if that
    would exceed limit.
    """
    ship(picked.sparkSession)
    names = [c for c in picked.columns if c != "source"]
    chunk = F.floor(F.col("block") / chunk_blocks)
    least, most = picked.agg(F.min(chunk), F.max(chunk)).first()
    if least is None:
        return picked.select("*", F.col("block").alias("first_block"), F.col("slot").alias("first_slot"))
    part = F.struct("block", "slot", "live_bytes", F.struct(*names).alias("file"))
    chunks = stash(picked.groupBy("source", (chunk - least).cast("long").alias("node")).agg(F.array_sort(F.collect_list(part)).alias("parts")))

    def of_files(parts: list[dict]) -> Fit:
        return Fit.of_files([(x["block"], x["slot"], x["live_bytes"]) for x in parts], limit)

    def of_children(parts: list[dict]) -> Fit:
        out = _fit(parts[0]["map"])
        for x in parts[1:]:
            out = out.then(_fit(x["map"]))
        return out

    plain = chunks.withColumn("parts", F.transform("parts", lambda p: F.struct(p["block"].alias("block"), p["slot"].alias("slot"), p["live_bytes"].alias("live_bytes"))))
    maps, levels, width = _with_maps(plain, of_files), [], most - least + 1
    while width > 1:
        child = F.struct("node", "map")
        level = stash(maps.groupBy("source", F.expr(f"node div {fan}").alias("node")).agg(F.array_sort(F.collect_list(child), lambda a, b: (a["node"] - b["node"]).cast("int")).alias("parts")))
        levels.append(level)
        maps, width = _with_maps(level, of_children), -(-width // fan)

    state = "struct<sum: long, block: long, slot: long>"
    state_type = pa.struct([("sum", pa.int64()), ("block", pa.int64()), ("slot", pa.int64())])

    def handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, nodes, states = [], [], []
            for source, parts, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (entry["sum"], entry["block"], entry["slot"])
                for x in parts:
                    sources.append(source)
                    nodes.append(x["node"])
                    states.append({"sum": now[0], "block": now[1], "slot": now[2]})
                    now = _fit(x["map"])(now)
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(nodes, pa.int64()), pa.array(states, state_type)], ["source", "node", "entry"])

    closed = F.struct(F.lit(_CLOSED).alias("sum"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot"))
    entries = None
    for level in reversed(levels):
        met = level.withColumn("entry", closed) if entries is None else level.join(entries, ["source", "node"])
        entries = met.select("source", "parts", "entry").mapInArrow(handed_down, f"source string, node long, entry {state}")
    met = chunks.withColumn("entry", closed) if entries is None else chunks.join(entries, ["source", "node"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = []
            for parts, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, block, slot = entry["sum"], entry["block"], entry["slot"]
                own = []
                for x in parts:
                    if held + x["live_bytes"] > limit:
                        held, block, slot = 0, x["block"], x["slot"]
                    held += x["live_bytes"]
                    own.append({"first_block": block, "first_slot": slot})
                firsts.append(own)
            kind = pa.list_(pa.struct([("first_block", pa.int64()), ("first_slot", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(firsts, kind)], ["source", "files", "firsts"])

    files_type = met.select(F.transform("parts", lambda p: p["file"]).alias("f")).schema["f"].dataType.simpleString()
    plain = F.transform("parts", lambda p: F.struct(p["block"].alias("block"), p["slot"].alias("slot"), p["live_bytes"].alias("live_bytes")))
    out = met.select(plain.alias("parts"), "entry", "source", F.transform("parts", lambda p: p["file"]).alias("files"))
    out = out.mapInArrow(grouped, f"source string, files {files_type}, firsts array<struct<first_block: long, first_slot: long>>")
    out = out.select("source", F.explode(F.arrays_zip("files", "firsts")).alias("x"))
    return out.select("source", "x.files.*", "x.firsts.*").select(*picked.columns, "first_block", "first_slot")


# -- the budget's cutoff --------------------------------------------------------------------------
def _key() -> Column:
    """Most files, fewest bytes, smallest source, block and slot come first."""
    return F.struct((-F.col("n_files")).alias("a"), F.col("bytes").alias("b"), F.col("source").alias("c"), F.col("block").alias("d"), F.col("slot").alias("e"))


def _literal(key) -> Column:
    kinds = ("long", "long", "string", "long", "long")
    return F.struct(*(F.lit(v).cast(t).alias(n) for n, v, t in zip("abcde", key, kinds, strict=True)))


def within_budget(queue: DataFrame, share: int = BUDGET_SHARE, pivots: int = PIVOTS) -> DataFrame:
    """The rows of the longest prefix of the queue whose bytes are at most share per cent of all: a weighted quickselect.

    A round brings `pivots` keys and as many sums to the driver, whatever the queue's length.
    """
    whole = queue.agg(F.sum(F.col("bytes").cast("decimal(38,0)"))).first()[0]
    if whole is None:
        return queue
    room, live, first_out, turn = int(whole) * share // 100, queue.withColumn("_key", _key()), None, 0
    live = live.select("_key", "bytes")
    while True:
        # an interval ends with the row of its last key, so a drawn key that was the last one is drawn again only if it is alone
        drawn = sorted(tuple(r[0]) for r in live.select("_key").orderBy(F.xxhash64("_key", F.lit(turn)), "_key").limit(pivots).collect())
        behind = sum(((F.col("_key") > _literal(k)).cast("int") for k in drawn), F.lit(0))
        sums = {r.i: (int(r.s), r.n) for r in live.groupBy(behind.alias("i")).agg(F.sum(F.col("bytes").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()}
        for i in range(len(drawn) + 1):
            weight, rows = sums.get(i, (0, 0))
            if weight > room:
                break
            room -= weight
        else:  # only in the first round: all fit
            return queue
        low = drawn[i - 1] if i else None
        high = drawn[i] if i < len(drawn) else first_out
        if low is not None:
            live = live.where(F.col("_key") > _literal(low))
        if i < len(drawn):
            live = live.where(F.col("_key") <= _literal(high))
        first_out, turn = high, turn + 1
        if rows == 1:
            last = live.first()["_key"]
            return queue.where(_key() < _literal(tuple(last)))


def queue_ranks(prefix: DataFrame) -> DataFrame:
    """prefix with queue_index, from 0 in the queue's order. Ranges of the key are sorted apart; their number is a setting, not the table's size."""
    n = int(prefix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("n_files").desc(), F.col("bytes"), F.col("source"), F.col("block"), F.col("slot")]
    rows = stash(prefix.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    first, total = {}, 0
    for r in sorted(rows.groupBy(part.alias("p")).count().collect()):
        first[r.p], total = total, total + r["count"]
    if not first:
        return rows.select(*prefix.columns, F.lit(0).cast("long").alias("queue_index"))
    offsets = F.array(*(F.lit(first.get(p, 0)).cast("long") for p in range(max(first) + 1)))
    return rows.select(*prefix.columns, (F.get(offsets, part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("queue_index"))


# -- contents -------------------------------------------------------------------------------------
def digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and live_sha256 of rows (keys, id, text): the digest of the lines `id:text` in the order of ids, streamed."""
    ship(rows.sparkSession)
    ordered = rows.select(*keys, "id", "text").repartition(*keys).sortWithinPartitions(*keys, "id", "text")
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    n = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, schema = None, None, None
        done: list[tuple] = []
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(i).with_nullable(True) for i in range(n)), pa.field("live_sha256", pa.string())])
            columns = [batch.column(i).to_pylist() for i in range(n + 1)]
            texts = batch.column(n + 1)
            for at, (*now, doc) in enumerate(zip(*columns, strict=True)):
                if now != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(f"{'' if doc is None else doc}:{texts[at].as_py()}\n".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, state.hexdigest()), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(work, ", ".join([*kinds, "live_sha256 string"]))


def compact(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each rewritten group and each file that stays: see the module's text.

    source, block, slot (of the first file), n_files, live_rows, bytes, cost and wave (null for a file that stays),
    live_sha256.
    """
    rows = located(docs, id_col, source_col, text_col)
    found = stash(files(rows))
    grouped = stash(next_fit(found.where("picked").select(*_FILE, "live_rows", "bytes", "live_bytes", "dirty")))
    groups = grouped.groupBy("source", F.col("first_block").alias("block"), F.col("first_slot").alias("slot")).agg(
        F.count("*").alias("n_files"), F.sum("live_rows").alias("live_rows"), F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"), F.max("dirty").alias("dirty")
    )
    queue = stash(groups.where("n_files > 1 or dirty").drop("dirty"))
    ranked = queue_ranks(within_budget(queue))
    cost = F.col("bytes") + F.col("live_bytes") + FILE_COST * F.col("n_files")
    rewritten = ranked.select(*_FILE, "n_files", "live_rows", "bytes", cost.alias("cost"), F.floor(F.col("queue_index") / WAVE).cast("long").alias("wave"))

    chosen = ranked.select("source", F.col("block").alias("first_block"), F.col("slot").alias("first_slot"))
    moved = grouped.join(chosen, ["source", "first_block", "first_slot"]).select(*_FILE, "first_block", "first_slot")
    units = stash(
        found.join(moved, list(_FILE), "left").select(*_FILE, "live_rows", "bytes", F.col("first_block").isNull().alias("stays"), F.coalesce("first_block", "block").alias("to_block"), F.coalesce("first_slot", "slot").alias("to_slot"))
    )
    none = F.lit(None).cast("long")
    staying = units.where("stays").select(*_FILE, F.lit(1).cast("long").alias("n_files"), "live_rows", "bytes", none.alias("cost"), none.alias("wave"))
    live = rows.where(~F.col("deleted")).join(units.select(*_FILE, "to_block", "to_slot"), list(_FILE))
    live = live.select("source", F.col("to_block").alias("block"), F.col("to_slot").alias("slot"), "id", "text")
    out = rewritten.union(staying).join(digests(live, list(_FILE)), list(_FILE), "left")
    return out.withColumn("live_sha256", F.coalesce("live_sha256", F.lit(hashlib.sha256().hexdigest())))


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(table(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, x)) AS t),
i AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
k AS (
  SELECT doc_id, CAST(xor(4294967295, list_reduce(list_transform(range(length(s)), lambda p: unicode(s[p + 1])), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8), 4294967295)) AS BIGINT) AS h
  FROM i, tab WHERE s <> '' UNION ALL SELECT doc_id, 0 FROM i WHERE s = ''),
b AS (
  SELECT d.doc_id, coalesce(d.source, '') AS source, coalesce(d.text, '') AS text, h, CAST(floor(coalesce(d.doc_id, 0) / {BLOCK_ROWS}) AS BIGINT) AS block, least(h % 8, h // 8 % 8) AS slot
  FROM documents d JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id),
r AS (SELECT *, octet_length(encode(text)) AS size, h // 64 % 100 < 9 * (((slot + block) % 8 + 8) % 8) AS deleted FROM b),
f AS (
  SELECT source, block, slot, count(*) AS n, count(*) FILTER (NOT deleted) AS live_rows, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (NOT deleted), 0) AS BIGINT) AS live_bytes
  FROM r GROUP BY ALL),
e AS (SELECT *, 100 * (n - live_rows) >= {DIRTY_SHARE} * n AS dirty FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY block, slot) AS place FROM e WHERE dirty OR 4 * bytes < 3 * {TARGET_BYTES}),
w AS (
  SELECT source, place, block, slot, live_rows, bytes, live_bytes, dirty, live_bytes AS held, block AS gb, slot AS gs FROM p WHERE place = 1
  UNION ALL
  SELECT p.source, p.place, p.block, p.slot, p.live_rows, p.bytes, p.live_bytes, p.dirty,
    CASE WHEN w.held + p.live_bytes > {TARGET_BYTES} THEN p.live_bytes ELSE w.held + p.live_bytes END,
    CASE WHEN w.held + p.live_bytes > {TARGET_BYTES} THEN p.block ELSE w.gb END,
    CASE WHEN w.held + p.live_bytes > {TARGET_BYTES} THEN p.slot ELSE w.gs END
  FROM w JOIN p ON p.source = w.source AND p.place = w.place + 1),
g AS (
  SELECT source, gb AS block, gs AS slot, count(*) AS n_files, sum(live_rows) AS live_rows, sum(bytes) AS bytes, sum(live_bytes) AS live_bytes
  FROM w GROUP BY ALL HAVING count(*) > 1 OR bool_or(dirty)),
q AS (
  SELECT *, row_number() OVER (ORDER BY n_files DESC, bytes, source, block, slot) - 1 AS qi,
    sum(bytes) OVER (ORDER BY n_files DESC, bytes, source, block, slot ROWS UNBOUNDED PRECEDING) AS upto, sum(bytes) OVER () AS whole
  FROM g),
c AS (SELECT * FROM q WHERE 100 * upto <= {BUDGET_SHARE} * whole),
u AS (
  SELECT e.source, e.block, e.slot, e.live_rows, e.bytes, coalesce(c.block, e.block) AS ub, coalesce(c.slot, e.slot) AS us, c.block IS NULL AS stays
  FROM e LEFT JOIN w ON w.source = e.source AND w.block = e.block AND w.slot = e.slot
  LEFT JOIN c ON c.source = w.source AND c.block = w.gb AND c.slot = w.gs),
x AS (
  SELECT u.source, u.ub, u.us, sha256(string_agg(coalesce(CAST(r.doc_id AS VARCHAR), '') || ':' || r.text || chr(10), '' ORDER BY r.doc_id NULLS FIRST, r.text)) AS sha
  FROM r JOIN u ON u.source = r.source AND u.block = r.block AND u.slot = r.slot WHERE NOT r.deleted GROUP BY ALL),
o AS (
  SELECT source, block, slot, n_files, live_rows, bytes, bytes + live_bytes + {FILE_COST} * n_files AS cost, qi // {WAVE} AS wave FROM c
  UNION ALL SELECT source, block, slot, 1, live_rows, bytes, NULL, NULL FROM u WHERE stays)
SELECT o.source, CAST(o.block AS BIGINT) AS block, CAST(o.slot AS BIGINT) AS slot, CAST(n_files AS BIGINT) AS n_files, CAST(live_rows AS BIGINT) AS live_rows, CAST(bytes AS BIGINT) AS bytes,
  CAST(cost AS BIGINT) AS cost, CAST(wave AS BIGINT) AS wave, coalesce(sha, sha256('')) AS live_sha256
FROM o LEFT JOIN x ON x.source = o.source AND x.ub = o.block AND x.us = o.slot
"""


QUERIES = {"op13_compaction": op13_compaction}
ORACLE_SQL = {"op13_compaction": _ORACLE}
