"""Writers: delimited tables, text, word lists, patches, printed tables."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.text import ROW_ORD
from verbatlas.operators.extract import blank_filled


def flat(df: DataFrame) -> DataFrame:
    """df with only what a delimited file can hold: structs named start and end become `start-end`."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "struct<start:int,end:int>":
            out.append(F.concat_ws("-", F.col(f.name)["start"].cast("string"), F.col(f.name)["end"].cast("string")).alias(f.name))
        elif not kind.startswith(("array", "map", "struct")):
            out.append(F.col(f.name))
        else:
            raise ValueError(f"column {f.name} is {kind}; choose its cells first")
    return blank_filled(df.select(*out))


def write_delimited(df: DataFrame, path: str, sep: str = ",", one_file: bool = False, order_col: str | None = None) -> None:
    """A folder of UTF-8 files with a header each; one_file: a single one, in the order of order_col."""
    out = df.orderBy(order_col) if order_col else df
    out = flat(out.drop(ROW_ORD))
    (out.coalesce(1) if one_file else out).write.csv(path, sep=sep, header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="overwrite")


def write_by_value(df: DataFrame, path: str, col: str, sep: str = ",") -> list[str]:
    """A folder of files for each value of col, all by one job; the folders' paths. Values are few, as in all partitioned tables."""
    spark = df.sparkSession
    key = F.md5(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("\x00null")))
    out = flat(df.drop(ROW_ORD)).withColumn("_of", key)
    out.write.partitionBy("_of").csv(path, sep=sep, header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="overwrite")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(str(f.getPath()) for f in found if f.getPath().getName().startswith("_of="))


def write_local(df: DataFrame, path: str, sep: str = ",", order_col: str | None = None, tally: dict[str, int] | None = None) -> int:
    """One file on the driver, rows streamed to it by partition; the number of rows.

    tally: told rows_written after each row, so that a run that is stopped knows how many stand in the file.
    """
    import csv

    out = flat((df.orderBy(order_col) if order_col else df).drop(ROW_ORD))
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, delimiter=sep, lineterminator="\n")
        w.writerow(out.columns)
        for n, row in enumerate(out.toLocalIterator(), 1):
            w.writerow(["" if x is None else x for x in row])
            if tally is not None:
                tally["rows_written"] = n
    if tally is not None:
        tally["rows_written"] = n
    return n


def write_lines(df: DataFrame, path: str, value_col: str, order_col: str = ROW_ORD, one_file: bool = True) -> None:
    """Text in the order given: one file, or a folder of files whose names are in that order."""
    out = df.orderBy(order_col).select(F.col(value_col).alias("value"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def write_words(words: DataFrame, path: str, one_file: bool = True) -> None:
    """Sorted, a word each line."""
    out = words.select(F.lower("word").alias("word")).distinct().orderBy("word")
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def patch(before: Iterable[str], after: Iterable[str], name: str) -> Iterator[str]:
    """A unified diff of two texts, by line."""
    return difflib.unified_diff(list(before), list(after), fromfile=f"a/{name}", tofile=f"b/{name}", lineterm="")


def write_patch(rows: DataFrame, before_col: str, after_col: str, path: str, name: str, order_col: str = ROW_ORD) -> None:
    """Of one document's lines, which the driver holds."""
    got = rows.orderBy(order_col).select(before_col, after_col).collect()
    Path(path).write_text("\n".join(patch((r[0] for r in got), (r[1] for r in got), name)) + "\n", encoding="utf-8")


def predictions_table(preds: list[tuple[str, float]]) -> str:
    """An ASCII table of tokens and probabilities, as wide as it must be."""
    a = max([5, *(len(t) for t, _ in preds)])
    b = max([11, *(len(f"{p:.6f}") for _, p in preds)])
    rule = f"+{'-' * (a + 2)}+{'-' * (b + 2)}+"
    body = [f"| {t:<{a}} | {p:>{b}.6f} |" for t, p in preds]
    return "\n".join([rule, f"| {'token':<{a}} | {'probability':>{b}} |", rule, *body, rule])


def hit_lines(hits: DataFrame, order_col: str, as_table: bool = False) -> Iterator[str]:
    """Lines to print for a lookup: each sentence, then its predictions (as a table with rules, if wanted); at last the count."""
    n = 0
    for n, r in enumerate(hits.orderBy(order_col).toLocalIterator(), 1):
        yield r.sentence
        if "preds" in hits.columns and as_table:
            yield predictions_table([(p.token, p.prob) for p in r.preds])
        elif "preds" in hits.columns:
            yield from (f"  {p.token:>15} {p.prob:.6g}" for p in r.preds)
    yield f"{n} sentences"


def intermediate_path(target: str, csv_only: bool = False, keep_csv: bool = False) -> str | None:
    """Where the table behind a workbook goes: `<stem>_intermediate.csv`, or beside it, or nowhere."""
    p = Path(target)
    if csv_only and p.suffix.lower() == ".xlsx":
        return str(p.with_name(f"{p.stem}_intermediate.csv"))
    return str(p.with_suffix(".csv")) if keep_csv or csv_only else None
