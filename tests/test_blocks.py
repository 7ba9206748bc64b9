"""Delimited files by byte ranges: the rows and numbers that one task reading the whole file gives."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from verbatlas.functions.text import ROW_ORD
from verbatlas.operators import extract
from verbatlas.sources import blocks, readers


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(spark, path, sep=","):
    """The same file by one task."""
    df = spark.read.csv(str(path), sep=sep, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)
    return [tuple("" if x is None else x for x in r) for r in df.collect()]


def cells(rng, wide):
    text = "".join(rng.choice(["a", "b", " ", ",", '"', "\n", "\r\n", "é", ";", "x" * 40]) for _ in range(rng.randrange(wide)))
    return rng.choice([text, text, "", "plain", "5.5"])


@pytest.mark.parametrize(("seed", "wide", "end"), [(1, 12, "\n"), (2, 60, "\n"), (3, 12, "\r\n"), (4, 400, "\n")])
def test_rows_and_numbers(spark, tmp_path, small_ranges, seed, wide, end):
    rng = random.Random(seed)
    rows = [[f"r{k}", *(cells(rng, wide) for _ in range(2))] for k in range(150)]
    path = tmp_path / "a.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "text", "other"])
        w.writerows(rows)
    df = readers.delimited(spark, str(path))
    numbered = readers.numbered_rows(df, "text").orderBy("csv_row_number").collect()
    assert [r.csv_row_number for r in numbered] == list(range(1, 151))
    plain = (lambda x: x.replace("\r\n", "\n")) if end == "\r\n" else str
    assert [(r.id, r.text, r.other) for r in numbered] == whole(spark, path) == [(a, plain(b), plain(c)) for a, b, c in rows]
    assert df.select(F.shiftright(ROW_ORD, 33)).distinct().count() >= 4
    assert spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions() >= 4


def test_odd_files(spark, tmp_path, small_ranges):
    """Blank lines, stray quotes, short and long rows, a header with a line break, a cell over many ranges, no end of line."""
    files = {
        "stray.csv": 'a,b\n5" pipe,x\n"q",6"\n,"in ""quotes"""\nx"y"z,"w"\n',
        "blank.csv": 'a,b\n\n1,2\n\n\n"3\n\n4",5\n\n',
        "short.csv": "a,b\n1\n1,2\n,\n",
        "header.csv": '"a\nx",b\n1,2\n3,4',
        "long.csv": 'a,b\n1,"' + "line\n" * 500 + '"\n2,"x"\n3,"' + "y\r\n" * 400 + '"',
        "tabs.tsv": 'a\tb\n"1\t\n"\t2,"3\n',
        "only.csv": "a,b\n",
        "one.csv": "a,b",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.write_bytes(text.encode())
        sep = "\t" if name.endswith("tsv") else ","
        df = readers.delimited(spark, str(path), sep)
        assert [tuple(r)[:-1] for r in df.orderBy(ROW_ORD).collect()] == whole(spark, path, sep), name
    assert readers.delimited(spark, str(tmp_path / "header.csv")).columns == ["a\nx", "b", ROW_ORD]


def test_several_files(spark, tmp_path, small_ranges):
    for k, rows in enumerate([["1,2", '"3\n3",4'], ["5,6"], []]):
        (tmp_path / f"{k}.csv").write_text("\n".join(["a,b", *rows]) + "\n")
    paths = [str(tmp_path / f"{k}.csv") for k in range(3)]
    got = readers.numbered_rows(readers.delimited(spark, paths), "a").orderBy("csv_row_number").collect()
    assert [tuple(r) for r in got] == [(1, "1", "2"), (2, "3\n3", "4"), (3, "5", "6")]
    (tmp_path / "9.csv").write_text("b,a\n7,8\n")
    got = readers.delimited(spark, [paths[0], str(tmp_path / "9.csv"), paths[1]]).orderBy(ROW_ORD)
    assert got.columns[:2] == ["a", "b"] and [(r.a, r.b) for r in got.collect()] == [("1", "2"), ("3\n3", "4"), ("5", "6"), ("8", "7")]


def test_states_compose():
    """The state behind a text is that of its lines in turn, whatever it was before."""
    for text, outside, inside in [('a,"b', True, False), ('a,"b"', False, False), ('"', True, False), ('""', False, True), ('x"y', False, False), ('","', False, True), ('a""b', False, True), ('"a"",b', True, False), ("", False, True)]:
        assert (blocks.inside_after(text, False, ","), blocks.inside_after(text, True, ",")) == (outside, inside), text


@pytest.mark.parametrize(("size", "overlap"), [(50, 7), (1000, 0), (333, 332), (10**6, 10)])
def test_chunks_of_files(spark, tmp_path, small_ranges, monkeypatch, size, overlap):
    """The chunks of whole texts, for files cut into ranges: CR LF at edges, no end of line, a BOM, empty files, bytes that are no text."""
    monkeypatch.setattr(blocks, "GATHERED", 200)
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice(["a", "é", "漢", " ", "\n", "\r\n", "\r", "\n\n", "x" * 30]) for _ in range(n))
    files = {"a.txt": text(900).encode(), "b.txt": b"\xef\xbb\xbf" + text(50).encode() + b"\r", "c.txt": b"", "d.txt": b"one\n", "e.txt": b"x\xff\xfey\r\nz", "f.txt": ("word " * 500).encode(), "g.txt": text(300).encode() + b"\r\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = [str(tmp_path / name) for name in files]
    got = sorted((r.doc_path[-5:], r.chunk_start, r.chunk_text) for r in blocks.char_chunks(spark, paths, size, overlap).collect())
    docs = readers.text_documents(spark, paths)
    want = sorted((r.doc_path[-5:], r.chunk_start, r.chunk_text) for r in extract.char_chunks(docs, "text", size, overlap).collect())
    assert got == want


@pytest.mark.parametrize("ends", [("\n", "\n", "\n"), ("", "\r\n", ""), ("\n", "", "\r")])
def test_a_text_in_several_files(spark, tmp_path, ends):
    """a folder's files are one text, so that no task writes or holds all of it."""
    bits = ["aé\nb" * 30, "\r\n\nc😀" * 25, "d" * 70]
    for name in ("x=1", "x=2"):
        (tmp_path / name).mkdir()
        for i, (bit, end) in enumerate(zip(bits, ends, strict=True)):
            (tmp_path / name / f"part-{i}.txt").write_bytes((name + bit + end).encode())
    got = blocks.char_chunks(spark, [str(tmp_path)], 50, 8, folders=True).collect()
    for name in ("x=1", "x=2"):
        text = "".join((name + bit + end).replace("\r\n", "\n").replace("\r", "\n") for bit, end in zip(bits, ends, strict=True))
        own = sorted((r.chunk_start, r.chunk_text) for r in got if r.doc_path.endswith(name))
        assert own == [(k, text[k : k + 50]) for k in range(0, max(1, len(text) - 50 + 42), 42)]
