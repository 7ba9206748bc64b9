"""Large text files by blocks: delimited records with line breaks in quotes, and overlapping chunks of characters.

Spark's text source cuts a file into byte ranges at line ends and reads them by many tasks. What a task cannot know is what
stands before its range: whether it begins inside quotes, or how many characters there were. Both are small facts of a range
that compose: a range maps `outside` and `inside` to one of the two, and adds up its characters. They are taken in a first pass
over the ranges and folded in the order of each file; a second pass cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.session import ship, stash


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, start (of the byte range), value: the lines of files, those of a range together and in order."""
    return spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value")


# -- records --------------------------------------------------------------------------------------
def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open behind a line, if one was (or was not) before it. Quotes count at a cell's begin only."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        close = line.find('"', at)
        if close < 0:
            return True
        inside = close + 1 < n and line[close + 1] == '"'
        at = close + 2 if inside else close + 1
        if not inside:
            at = line.find(sep, at)
            if at < 0:
                return False
            at += len(sep)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """The rows of each range (first two columns), without these."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[:2]

        def own() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == key:
                yield ahead[2:]
                ahead = next(rows, None)

        yield key, own()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of each range."""
    for key, own in _rows_of(batches):
        yield key, (value for (value,) in own)


def records(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """file, start, place, text: the records of delimited files, without blank ones; the first of a file is its header.

    start and place tell their order in the file: the byte range that a record begins in, and its number there, from 0.
    """
    ship(spark)
    lines = _lines(spark, paths).select("file", "start", "value")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in _runs(batches):
            a, b, first = False, True, None
            for line in own:
                first = line if first is None else first
                if '"' in line:
                    a, b = inside_after(line, a, sep), inside_after(line, b, sep)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([a]), pa.array([b]), pa.array([start == 0 and first.endswith("\r")])], ["file", "start", "a", "b", "crlf"])

    blocks = stash(lines.mapInArrow(states, "file string, start long, a boolean, b boolean, crlf boolean"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "a", "b")))
    begin = F.struct(F.lit(False).alias("now"), F.expr("cast(array() as array<bigint>)").alias("open"))
    step = lambda s, x: F.struct(F.when(s["now"], x["b"]).otherwise(x["a"]).alias("now"), F.when(s["now"], F.concat(s["open"], F.array(x["start"]))).otherwise(s["open"]).alias("open"))
    folded = blocks.groupBy("file").agg(F.aggregate(ordered, begin, step)["open"].alias("open"))
    # files whose first line ends with CR LF (in these CR LF is one line end everywhere), and ranges (of some MB each) that begin inside quotes
    crlf = {r.file for r in blocks.where("crlf").select("file").collect()}
    inside = {(r.file, r.start) for r in folded.select("file", F.explode("open").alias("start")).collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in _runs(batches):
            now, place, part, head, out = (file, start) in inside, 0, [], (file, start) in inside, []
            held, windows = 0, file in crlf
            for line in own:
                part.append(line.removesuffix("\r") if windows else line)
                now = inside_after(line, now, sep)
                if not now:
                    text = "\n".join(part)
                    if head or text:
                        out.append((-1 if head else place, "head" if head else "whole", text))
                        held += len(text)
                        place += not head
                    part, head = [], False
                    if held > 4_000_000:
                        yield batch_of(file, start, out)
                        out, held = [], 0
            if part:  # goes on in the next range
                out.append((-1 if head else place, "through" if head else "tail", "\n".join(part)))
            if out:
                yield batch_of(file, start, out)

    def batch_of(file: str, start: int, out: list[tuple]) -> pa.RecordBatch:
        place, kind, text = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(out)), pa.array([start] * len(out), pa.int64()), pa.array(place, pa.int64()), pa.array(kind), pa.array(text, pa.string())], ["file", "start", "place", "kind", "text"])

    found = stash(lines.mapInArrow(cut, "file string, start long, place long, kind string, text string"))
    # what spans ranges: a tail and all that follows it up to the next tail; two rows of a range at most
    parts = found.where("kind != 'whole'")
    order = W.partitionBy("file").orderBy("start", F.col("kind") == "tail")
    parts = parts.withColumn("group", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    listed = F.array_sort(F.collect_list(F.struct("start", (F.col("kind") == "tail").alias("tail"), "place", "text")))
    joined = parts.groupBy("file", "group").agg(listed.alias("x"), F.bool_or(F.col("kind") == "tail").alias("begun"))
    first = F.when(F.col("begun"), F.element_at(F.filter("x", lambda p: p["tail"]), 1))
    text = F.array_join(F.transform("x", lambda p: p["text"]), "\n")
    spanning = joined.select("file", first["start"].alias("start"), first["place"].alias("place"), text.alias("text"))
    return found.where("kind = 'whole'").select("file", "start", "place", "text").union(spanning)


def in_order(rows: DataFrame, out_col: str) -> DataFrame:
    """rows of `records` without the headers, with out_col: a number in the order of file and place; the upper bits tell ranges apart and the lower 33 have no gaps."""
    rows = rows.where("start > 0 or place > 0")
    starts = rows.groupBy("file", "start").agg(F.min("place").alias("_least"))
    ranked = starts.select(F.col("file").alias("_f"), F.col("start").alias("_s"), "_least", (F.row_number().over(W.orderBy("file", "start")) - 1).cast("long").alias("_range"))  # a row for each range
    met = rows.join(ranked, (rows["file"] == ranked["_f"]) & (rows["start"] == ranked["_s"]))
    return met.select(*rows.columns, (F.shiftleft("_range", 33) + F.col("place") - F.col("_least")).alias(out_col))


# -- chunks of characters -------------------------------------------------------------------------
#: Characters that a task gathers before it hands on the pieces of chunks in them.
GATHERED = 1_000_000


def _unix(line: str, ended: bool) -> str:
    """A line (cut at LF) with LF line ends; ended: an LF stood behind it."""
    if not ended:
        return line.replace("\r\n", "\n").replace("\r", "\n")
    return line.removesuffix("\r").replace("\r", "\n") + "\n"


def char_chunks(spark: SparkSession, paths: list[str], size: int = 2_000_000, overlap: int = 5_000, folders: bool = False) -> DataFrame:
    """doc_path, chunk_start, chunk_text: the chunks that `extract.char_chunks` cuts of each file's text, for files of any length.

    folders: the files of a folder, in the order of their names, are one text, whose doc_path is the folder.

    A byte range hands on the pieces of the chunks that its characters lie in, and a chunk's pieces meet; no task holds more of a
    file than GATHERED characters, a line, or a chunk. Files are in UTF-8; bytes that are no text are replaced.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be 0 or more and less than the size")
    ship(spark)
    step = size - overlap
    read = _lines(spark, paths)
    lines = read.select("file", "start", F.make_valid_utf8("value").alias("value"), F.octet_length("value").alias("n"), "size")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in _rows_of(batches):
            chars, octets, size_, last = 0, 0, 0, ""
            for value, n, size_ in own:
                value = value.removeprefix("﻿") if start == 0 and not octets else value
                chars, octets, last = chars + len(_unix(value, True)), octets + n + 1, value
            less = len(_unix(last, True)) - len(_unix(last, False))  # if no line end stands behind the last line of the file
            columns = [pa.array([file]), *(pa.array([x], pa.int64()) for x in (start, chars, octets, size_, less))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "start", "chars", "octets", "size", "less"])

    ranges = stash(lines.mapInArrow(measured, "file string, start long, chars long, octets long, size long, less long"))
    ranges = ranges.withColumn("doc", F.regexp_replace("file", "/[^/]*$", "") if folders else F.col("file"))
    own, behind, whole = W.partitionBy("file"), W.partitionBy("doc").orderBy("file", "start"), W.partitionBy("doc")
    ranges = ranges.withColumn("open_end", (F.col("start") == F.max("start").over(own)) & (F.sum("octets").over(own) > F.col("size")))
    ranges = ranges.withColumn("chars", F.col("chars") - F.when(F.col("open_end"), F.col("less")).otherwise(0))
    ranges = ranges.select("doc", F.col("file").alias("_f"), F.col("start").alias("_s"), (F.sum("chars").over(behind) - F.col("chars")).alias("before"), F.sum("chars").over(whole).alias("total"), "open_end")
    # a row for each range, so for some MB; the lines stay where and in the order they are
    met = lines.join(F.broadcast(ranges), (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, start), own in _rows_of(batches):
            held, n, at, total, ahead, fresh = [], 0, None, 0, None, start == 0
            for value, before, total, open_end, doc in own:
                at = before if at is None else at
                if ahead is not None:
                    held.append(_unix(ahead, True))
                    n += len(held[-1])
                ahead, fresh = value.removeprefix("﻿") if fresh else value, False
                if n >= GATHERED:
                    yield pieces(doc, at, "".join(held), total)
                    held, at, n = [], at + n, 0
            held.append(_unix(ahead, not open_end))
            yield pieces(doc, at, "".join(held), total)

    def pieces(doc: str, at: int, text: str, total: int) -> pa.RecordBatch:
        last = max(0, -(-(total - size) // step))
        rows = []
        for k in range(max(0, (at - size) // step + 1), min(last, (at + len(text) - 1) // step) + 1):
            begin = max(k * step, at)
            piece = text[begin - at : k * step + size - at]
            if piece:
                rows.append((k, begin, piece))
        k, begin, piece = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), pa.array(k, pa.int64()), pa.array(begin, pa.int64()), pa.array(piece, pa.string())], ["doc", "k", "begin", "piece"])

    found = met.select("file", "start", "value", "before", "total", "open_end", "doc").mapInArrow(cut, "doc string, k long, begin long, piece string")
    joined = found.groupBy("doc", "k").agg(F.array_sort(F.collect_list(F.struct("begin", "piece"))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: p["piece"]), "")
    return joined.select(F.regexp_replace("doc", "^file:/+", "/").alias("doc_path"), (F.col("k") * step).alias("chunk_start"), text.alias("chunk_text"))
