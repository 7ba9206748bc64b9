"""Readers of text, delimited tables, word lists and path lists."""

from __future__ import annotations

import warnings
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.text import ROW_ORD, filled, unix_lines
from verbatlas.operators.naming import require
from verbatlas.sources import blocks


def path_list(paths: list[str] | None = None, paths_file: str | None = None) -> list[str]:
    """Paths given and those of a file (a line each, `#` starts a comment), in order, without repeats."""
    found = list(paths or [])
    if paths_file:
        lines = Path(paths_file).read_text(encoding="utf-8").splitlines()
        found += [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
    return list(dict.fromkeys(p if "://" in p else str(Path(p).expanduser().resolve()) for p in found))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that can be reached; others are warned of and left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        try:
            there = path.getFileSystem(conf).exists(path)
        except Exception as e:  # an unknown scheme or no access
            warnings.warn(f"{p}: {e}", stacklevel=2)
            there = False
        if there:
            out.append(p)
        else:
            warnings.warn(f"{p} is missing and left out", stacklevel=2)
    return out


def text_documents(spark: SparkSession, paths: list[str], encoding: str = "utf-8") -> DataFrame:
    """doc_path, text: a row for each file, with LF line ends. Bytes that are no text are replaced.

    Spark reads one file by one task; files beyond some hundred MB are better cut up before.
    """
    files = spark.read.format("binaryFile").load(existing(spark, paths))
    utf8 = encoding.lower().replace("_", "-") in ("utf-8", "utf8", "utf-8-sig")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "") if utf8 else F.decode("content", encoding)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("doc_path"), unix_lines(text).alias("text"))


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value and row_ord of each line, without its line end."""
    return spark.read.text(paths).withColumn(ROW_ORD, F.monotonically_increasing_id())


def delimited(spark: SparkSession, paths: str | list[str], sep: str = ",", encoding: str = "utf-8", needed: list[str] | None = None, order: bool = True) -> DataFrame:
    """A table with a header: all cells are text, missing ones empty, quotes doubled inside quotes, line breaks allowed in quotes.

    row_ord follows the file's order (several files: by path, then place). A header with a repeated name is
    an error, as its cells could not be told apart. A file in UTF-8 is read by many tasks, each a byte range of it (see
    `blocks`); any other encoding makes it one task.
    """
    many = [paths] if isinstance(paths, str) else list(paths)
    if len(many) > 1:
        same_columns(spark, many, sep, encoding)
    header = _header(spark, many[0], sep, encoding)
    if len(set(header)) < len(header):
        raise ValueError("a column name is repeated")
    if needed:
        require(header, needed)
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8") and header:
        # files may have the columns in other orders; most often there is one
        orders: dict[tuple[str, ...], list[str]] = {}
        for p in many:
            orders.setdefault(tuple(_header(spark, p, sep, encoding)) or tuple(header), []).append(p)
        found = [blocks.records(spark, own, sep).withColumn("_h", F.lit(k)) for k, own in enumerate(orders.values())]
        rows = blocks.in_order(reduce(DataFrame.union, found), ROW_ORD)
        options = {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"}
        tables = []
        for k, own in enumerate(orders):
            names = {c: f"c{i}" for i, c in enumerate(own)}
            part = rows.where(F.col("_h") == k).select(F.from_csv("text", ", ".join(f"{n} string" for n in names.values()), options).alias("c"), ROW_ORD)
            tables.append(part.select(*(filled(f"c.{names[c]}").alias(c) for c in header), ROW_ORD))
        out = reduce(DataFrame.union, tables)
        return out if order else out.drop(ROW_ORD)
    df = spark.read.csv(many, sep=sep, header=True, inferSchema=False, multiLine=True, escape='"', encoding=encoding, maxCharsPerColumn=-1, enforceSchema=False)
    out = df.select(*(filled(f"`{c}`").alias(c) for c in df.columns))
    return out.withColumn(ROW_ORD, F.monotonically_increasing_id()) if order else out


def cell_rows(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> tuple[list[str], DataFrame]:
    """The header of a delimited file as it stands (blank and repeated names too), and its rows as arrays of as many cells."""
    header = _header(spark, path, sep, encoding)
    names = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{n} string" for n in names) or "c0 string"
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        rows = blocks.records(spark, [path], sep).where("start > 0 or place > 0")
        rows = rows.select(F.from_csv("text", schema, {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"}).alias("c")).select("c.*")
    else:
        rows = spark.read.csv(path, sep=sep, header=True, schema=schema, multiLine=True, escape='"', encoding=encoding, maxCharsPerColumn=-1)
    return header, rows.select(F.array(*map(filled, names or ["c0"])).alias("cells"))


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """The cells of a file's first record, which may hold line breaks."""
    first = spark.read.csv(path, sep=sep, header=False, inferSchema=False, multiLine=True, escape='"', encoding=encoding, maxCharsPerColumn=-1).first()
    return [] if first is None else [("" if x is None else x) for x in first]


def same_columns(spark: SparkSession, paths: list[str], sep: str = ",", encoding: str = "utf-8", text_col: str | None = None) -> None:
    """All tables must have the same set of columns, and the text column if one is named."""
    sets = {p: set(spark.read.csv(p, sep=sep, header=True, encoding=encoding, multiLine=True, escape='"').columns) for p in paths}
    for p, own in sets.items():
        if text_col and text_col not in own:
            raise ValueError(f"{p} has no column {text_col}")
        if own != sets[paths[0]]:
            raise ValueError(f"{p} and {paths[0]} have different columns")


def numbered_rows(df: DataFrame, text_col: str, order_col: str = ROW_ORD) -> DataFrame:
    """csv_row_number (from 1, gapless), text, and the other columns, of a delimited table.

    Numbers come from two steps: rows are counted by the part of the order that tells Spark's tasks apart,
    and running sums of those counts start each part's own numbers.
    """
    from pyspark.sql import Window as W

    part = F.shiftright(order_col, 33)
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).drop("_n")
    own = F.col(order_col) - (F.shiftleft("_part", 33))
    rest = [c for c in df.columns if c not in (text_col, order_col)]
    out = rows.join(F.broadcast(before), rows["_part"] == before["_p"])
    return out.select((own + F.col("_before") + 1).cast("long").alias("csv_row_number"), F.col(text_col).alias("text"), *rest)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: lower case, blanks and `#` lines left out."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).where("word != '' and word not like '#%'").distinct()


def count_rows(df: DataFrame) -> int:
    return df.count()


def single_column(spark: SparkSession, path: str, field: str, sep: str = ",") -> DataFrame:
    """One column of a delimited table; the reader skips the others."""
    return delimited(spark, path, sep, needed=[field]).select(field, ROW_ORD)


def clause_database(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, sep="\t", needed=["lemma", "sentence_text"])
