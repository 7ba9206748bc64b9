"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Inner products become distances by one more component (the root of the largest squared norm less the
vector's own; 0 for a query), so that the nearest by distance has the largest product.

* Fit, on the driver, on a bounded sample (SAMPLE_ROWS rows, SAMPLE_VALUES values at most): the sample is halved
  again and again at the median along its widest direction, which gives lists of equal size; each list's
  mean is its centroid. Centroids are searched by a graph in memory: the nearest neighbours of each, and
  some links at random. How much farther than the nearest a list may be and still be searched (the
  distance ratio) is calibrated on the sample for a share of RECALL of the true neighbours.
* Every vector goes to the list of its nearest centroid, and boundary vectors to a few more whose
  centroids are almost as near.
* Lists are packed into cells of about CELL_VALUES values; longer lists are split into several cells by a
  hash. A query goes once to each cell that holds lists it selects. A cell's rows are held, its queries
  stream past, and each leaves its best there; the best of all cells are the answer.
* A query selects at least as many lists as it takes to hold k candidates.

Scores are inner products of the original vectors in double precision, summed in one order whatever the
batch; ties go to the smaller id.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as query or candidate; an id that repeats counts once, with its best row (a
query leaves out rows of its own id); fewer candidates than k are all returned; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.session import ship, stash, table

#: The sample has LIST_ROWS rows for each list wanted (the root of the table's rows), within these bounds.
SAMPLE_ROWS, SAMPLE_VALUES, LIST_ROWS = 131_072, 8_000_000, 16
LEAST_SAMPLE = 16_384
MOST_LISTS = 8_192
#: Links of each centroid to its nearest, and at random.
NEAREST, RANDOM = 16, 4
#: A vector is put also into lists up to so much farther than its nearest one, into COPIES at most.
BOUNDARY, COPIES = 0.02, 3
RECALL = 0.985
#: Rows of a cell, and values (rows times components); a query leaves k rows in each of its cells.
CELL_ROWS, CELL_VALUES = 65_536, 1_048_576
BATCH = 256
#: Centroids that a point keeps at first while the graph is searched.
WIDTH = 64
#: Centroids expanded at least before a vector is put into lists.
ASSIGN_LEAST = 16


@dataclass
class Index:
    """Centroids in the space of distances, their graph, and the calibrated ratio."""

    centroids: np.ndarray
    links: np.ndarray
    top: float
    ratio: float

    def lifted(self, v: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, self.top - (v * v).sum(axis=1)))
        return np.hstack([v, more[:, None]])

    def nearest(self, points: np.ndarray, ratio: float, enough: np.ndarray | None = None, k: int = 0, least: int = 8, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """For each point the nearest centroids that the graph search came to, nearest first, and their distances.

        The nearest open centroids are expanded while they are within `ratio` of the nearest one, while
        fewer than `least` were expanded, or while those expanded hold (by `enough`) fewer than k rows.
        A point keeps the `width` nearest it came to; where all of them were expanded it is searched again
        with four times as many, so the work follows the lists selected, not the number of centroids.
        Where there are fewer, the number is -1 and the distance infinite.
        """
        n, m = len(points), len(self.centroids)
        width = min(width, m)
        norms, own = (self.centroids**2).sum(axis=1), (points**2).sum(axis=1)
        node, dist = np.full((n, width), -1), np.full((n, width), np.inf)
        done, seen = np.zeros((n, width), bool), np.zeros(n * m, bool)
        count, held = np.zeros(n, np.int64), np.zeros(n)
        at_once = max(1, width // 16)

        def visit(flat: np.ndarray) -> None:
            """flat: point * m + centroid, in order, each once."""
            flat = flat[~seen[flat]]
            if not len(flat):
                return
            seen[flat] = True
            r, c = np.divmod(flat, m)
            d = np.sqrt(np.maximum(own[r] + norms[c] - 2 * np.einsum("ij,ij->i", points[r], self.centroids[c]), 0.0))
            at, first, times = np.unique(r, return_index=True, return_counts=True)
            row = np.repeat(np.arange(len(at)), times)
            col = width + np.arange(len(r)) - first[row]
            more = width + times.max()
            nodes, dists, dones = np.full((len(at), more), -1), np.full((len(at), more), np.inf), np.zeros((len(at), more), bool)
            nodes[:, :width], dists[:, :width], dones[:, :width] = node[at], dist[at], done[at]
            nodes[row, col], dists[row, col] = c, d
            order = np.argsort(dists, axis=1, kind="stable")[:, :width]
            node[at], dist[at], done[at] = (np.take_along_axis(x, order, axis=1) for x in (nodes, dists, dones))

        starts = np.unique(np.linspace(0, m - 1, min(m, 8)).astype(int))
        visit((np.arange(n)[:, None] * m + starts).ravel())
        active = np.arange(n)
        while len(active):
            open_ = ~done[active] & (node[active] >= 0)
            place = np.cumsum(open_, axis=1)
            limit = ratio * np.maximum(dist[active, :1], 1e-300) + 1e-12
            short = (count[active] < least) | (held[active] < k if enough is not None else False)
            go = open_ & (place <= at_once) & ((dist[active] <= limit) | (short[:, None] & (place == 1)))
            r, p = np.nonzero(go)
            r = active[r]
            if not len(r):
                break
            done[r, p] = True
            nodes = node[r, p]
            np.add.at(count, r, 1)
            if enough is not None:
                np.add.at(held, r, enough[nodes])
            active = np.unique(r)
            visit(np.unique((r[:, None] * m + self.links[nodes]).ravel()))
        again = np.flatnonzero(done.all(axis=1)) if width < m else np.zeros(0, int)
        if len(again):
            more_node, more_dist = self.nearest(points[again], ratio, enough, k, least, 4 * width)
            spare = more_node.shape[1] - width
            node = np.pad(node, ((0, 0), (0, spare)), constant_values=-1)
            dist = np.pad(dist, ((0, 0), (0, spare)), constant_values=np.inf)
            node[again], dist[again] = more_node, more_dist
        return node, dist

    def search(self, points: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of each point to all centroids; infinite where `nearest` does not give one."""
        node, dist = self.nearest(points, ratio)
        out = np.full((len(points), len(self.centroids)), np.inf)
        r, p = np.nonzero(node >= 0)
        out[r, node[r, p]] = dist[r, p]
        return out


def _halved(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of `lists` (a power of two) parts of equal size."""
    parts = [points]
    while len(parts) < lists:
        nxt = []
        for x in parts:
            centred = x - x.mean(axis=0)
            way = centred[np.argmax((centred**2).sum(axis=1))]
            for _ in range(6):  # towards the widest direction
                way = centred.T @ (centred @ way)
                size = np.linalg.norm(way)
                if size == 0:
                    break
                way = way / size
            order = np.argsort(centred @ way, kind="stable")
            half = len(order) // 2
            nxt += [x[order[:half]], x[order[half:]]]
        parts = nxt
    return np.stack([x.mean(axis=0) for x in parts])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0.0))


def _graph(centroids: np.ndarray) -> np.ndarray:
    """Row i: the centroids that i links to. The next one by number is always among them, so all can be reached."""
    m = len(centroids)
    near = np.vstack([np.argsort(_distances(centroids[lo : lo + 512], centroids), axis=1, kind="stable")[:, 1 : NEAREST + 1] for lo in range(0, m, 512)])
    rng = np.random.default_rng(17)
    ring = (np.arange(m)[:, None] + 1) % m
    return np.hstack([near, ring, rng.integers(0, m, (m, RANDOM))])


def _boundary(nodes: np.ndarray, dist: np.ndarray) -> list[np.ndarray]:
    """The same as boundary_lists from numbers and distances of lists, nearest first."""
    keep = dist[:, :COPIES] <= (1 + BOUNDARY) * dist[:, :1] + 1e-12
    return [x[k] for x, k in zip(nodes[:, :COPIES], keep, strict=True)]


def boundary_lists(dist: np.ndarray) -> list[np.ndarray]:
    """For each point the list of its nearest centroid first, then those almost as near."""
    order = np.argsort(dist, axis=1, kind="stable")[:, :COPIES]
    return _boundary(order, np.take_along_axis(dist, order, axis=1))


def wanted_lists(rows: int) -> int:
    """Lists for a table: a power of two, about the root of its rows, MOST_LISTS at most."""
    lists = 1
    while lists * lists < rows and lists < MOST_LISTS:
        lists *= 2
    return lists


def fit(sample: np.ndarray, rows: int, top: float, k: int) -> Index:
    """sample: vectors; rows: of the whole table; top: the largest squared norm there."""
    lists = wanted_lists(rows)
    while lists > 1 and lists // 2 * LIST_ROWS > len(sample):
        lists //= 2
    index = Index(np.zeros((1, 1)), np.zeros((1, 1), int), top, 1.0)
    index.centroids = _halved(index.lifted(sample, False), lists)
    index.links = _graph(index.centroids)
    # the ratio at which a share of RECALL of the sample's own neighbours lies in selected lists
    asked, best = sample[:: max(1, len(sample) // 256)][:256], min(k + 1, len(sample))
    true = np.vstack([np.argpartition(-(asked[lo : lo + 32] @ sample.T), best - 1, axis=1)[:, :best] for lo in range(0, len(asked), 32)])
    to = _distances(index.lifted(asked, True), index.centroids)
    to = to / np.maximum(to.min(axis=1, keepdims=True), 1e-12)
    rows_, place = np.unique(true, return_inverse=True)
    own: list[np.ndarray] = []
    for lo in range(0, len(rows_), 512):
        own += boundary_lists(_distances(index.lifted(sample[rows_[lo : lo + 512]], False), index.centroids))
    need = np.array([to[i, own[j]].min() for i, js in enumerate(place.reshape(true.shape)) for j in js])
    index.ratio = float(np.quantile(need, RECALL)) if len(need) else 1.0
    return index


def usable(vector: Column) -> Column:
    """Whether a vector takes part, but for its length."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vector.cast("array<double>")
    return vector.isNotNull() & F.coalesce(~F.exists(v, bad), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids, each id once."""
    at = np.lexsort((ids, -scores))
    _, first = np.unique(ids[at], return_index=True)
    return at[np.sort(first)][:k]


def _held(cell: pa.Table) -> dict:
    """A cell's vectors, each once, and where the rows of each list are."""
    of = cell.column("lists").combine_chunks().flatten().to_numpy()
    ids, vec = cell.column("id").to_numpy(), _matrix(cell.column("vec"))
    _, first, place = np.unique(np.column_stack([(ids >> 32).astype(np.float64), (ids & 0xFFFFFFFF).astype(np.float64), vec]), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(of, kind="stable")
    lists, starts = np.unique(of[order], return_index=True)
    by_list = dict(zip(lists.tolist(), np.split(place.ravel()[order], starts[1:]), strict=True))
    ids, vec = ids[first], vec[first]
    return {"id": ids, "vec": vec, "of": by_list, "norm": float(np.sqrt((vec * vec).sum(axis=1).max())), "repeats": len(np.unique(ids)) < len(ids)}


def _ranked(rows: dict, queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a cell for each of its queries."""
    q = _matrix(queries.column("vec"))
    ids = queries.column("id").to_numpy()
    asked = queries.column("lists").to_pylist()
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(ids)):
        mark = np.zeros(len(rows["id"]), bool)
        for x in asked[i]:
            if x in rows["of"]:
                mark[rows["of"][x]] = True
        at = np.flatnonzero(mark & (rows["id"] != ids[i]))
        if not len(at):
            continue
        rough = rows["vec"][at] @ q[i]
        if len(at) > k and not rows["repeats"]:  # sums in another order may differ in the last places: keep all that may be among the k
            slack = 1e-9 * (np.abs(rough).max() + np.linalg.norm(q[i]) * rows["norm"])
            at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
        exact = (rows["vec"][at] * q[i]).sum(axis=1)
        best = _best(rows["id"][at], exact, k)
        out[0].append(np.full(len(best), ids[i]))
        out[1].append(rows["id"][at][best])
        out[2].append(exact[best])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` marks its k nearest among all other rows.

    ratio: the distance ratio instead of the calibrated one; infinity searches every list, which is exact.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked"))
    empty = "query_id long, rank int, vec_id long, score double"
    lengths = good.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], empty)
    dim, rows = lengths[0].n, lengths[0].c
    good = good.where(F.size("vec") == dim)
    square = F.aggregate(F.col("vec"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = good.agg(F.max(square)).first()[0] * (1 + 1e-12)
    take = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim, max(LEAST_SAMPLE, LIST_ROWS * wanted_lists(rows))))
    order = F.xxhash64("id", "vec")
    picked = good.where(F.pmod(order, F.lit(1_000_000)) < int(min(1.0, 1.1 * take / rows) * 1_000_000) + 1) if rows > take else good
    sample = picked.select("vec").orderBy(order).limit(take).toArrow()
    fitted = fit(_matrix(sample.column("vec")), rows, top, k)
    if ratio is not None:
        fitted.ratio = ratio
    model = spark.sparkContext.broadcast(fitted)
    lists = len(fitted.centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                near = index.nearest(index.lifted(_matrix(part.column(1)), False), 1 + BOUNDARY, least=ASSIGN_LEAST)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.astype(np.int32) for x in _boundary(*near)], pa.list_(pa.int32()))], ["id", "vec", "asked", "lists"])

    placed = stash(good.mapInArrow(assign, f"id long, vec {kind}, asked boolean, lists array<int>"))
    # rows of each list, with and without boundary copies: numbers for MOST_LISTS lists at most
    sizes, firsts = np.zeros(lists, np.int64), np.zeros(lists)
    for r in placed.select(F.posexplode("lists").alias("at", "list")).groupBy("list").agg(F.count("*").alias("n"), F.sum((F.col("at") == 0).cast("long")).alias("own")).collect():
        sizes[r.list], firsts[r.list] = r.n, r.own
    cell_rows = max(1, min(CELL_ROWS, CELL_VALUES // dim))
    first_cell, splits, cell, filled = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for x in range(lists):
        splits[x] = max(1, -(-sizes[x] // cell_rows))
        if filled and (filled + sizes[x] > cell_rows or splits[x] > 1):
            cell, filled = cell + 1, 0
        first_cell[x] = cell
        filled += sizes[x]
        if splits[x] > 1:
            cell, filled = cell + splits[x], 0
    plan = spark.sparkContext.broadcast((first_cell, splits, firsts))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (start, parts, own) = model.value, plan.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                near = index.nearest(index.lifted(_matrix(part.column(1)), True), index.ratio, own, k + 1)
                at, cells, chosen = [], [], []
                for i, (nodes, d) in enumerate(zip(*near, strict=True)):
                    nodes, d = nodes[nodes >= 0], d[nodes >= 0]
                    held = np.cumsum(own[nodes])
                    keep = (d <= index.ratio * max(d[0], 1e-300) + 1e-12) | (np.concatenate([[0], held[:-1]]) < k + 1)
                    by: dict[int, list[int]] = {}
                    for x in nodes[keep]:
                        for c in range(start[x], start[x] + parts[x]):
                            by.setdefault(int(c), []).append(int(x))
                    at += [i] * len(by)
                    cells += by.keys()
                    chosen += by.values()
                rows_ = part.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([1] * len(at), pa.int32()), rows_.column(0), rows_.column(1), pa.array(chosen, pa.list_(pa.int32()))], ["cell", "kind", "id", "vec", "lists"])

    asked = placed.where("asked").select("id", "vec").mapInArrow(select, f"cell long, kind int, id long, vec {kind}, lists array<int>")
    at = lambda values: F.element_at(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), F.col("list") + 1)
    stored = placed.select("id", "vec", F.explode("lists").alias("list")).select(
        (at(first_cell) + F.pmod(F.xxhash64("id"), at(splits))).alias("cell"), F.lit(0).alias("kind"), "id", "vec", F.array("list").alias("lists")
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, rows = None, [], {}
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(cells)), strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, held, rows = cells[a], [], {}
                if kinds[a] == 0:
                    held.append(part)
                    rows = {}
                    continue
                if held and not rows:
                    rows = _held(pa.Table.from_batches(held))
                if rows:
                    for lo in range(0, part.num_rows, BATCH):
                        yield from _ranked(rows, part.slice(lo, BATCH), k)

    found = stored.union(asked).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(answer, "query_id long, vec_id long, score double")
    # a boundary vector is found in each of its lists
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_ann": op3_ann}
ORACLE_SQL: dict[str, str] = {}
