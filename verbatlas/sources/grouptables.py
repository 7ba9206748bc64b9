"""Group definitions: ragged tables of lemmas by column, and matrices of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.text import ROW_ORD, filled, strip, whole_number
from verbatlas.sources import readers

LONG = "lemma string, group string, group_pos int"


def from_columns(spark: SparkSession, columns: dict[str, list[str]]) -> DataFrame:
    """The long table (lemma, group, group_pos) of a dictionary of lists."""
    return spark.createDataFrame([(x, g, k) for k, (g, xs) in enumerate(columns.items()) for x in xs], LONG)


def from_rows(spark: SparkSession, rows: list[list[str]], profile: str = "standard") -> DataFrame:
    """The long table of a ragged table whose first row has the labels.

    standard: labels are stripped, and columns with a blank label drop out before cells are matched to
    labels, so that later columns move up; a cell is one lemma. fused: labels stay as they are, a cell may
    hold several lemmas between commas, and missing cells are empty. Repeated labels are an error.
    """
    if not rows:
        raise ValueError("the group table is empty")
    labels = list(rows[0]) if profile == "fused" else [c.strip() for c in rows[0] if c.strip()]
    if len(set(labels)) < len(labels):
        raise ValueError("group labels must differ")
    found: dict[tuple[str, int], None] = {}
    for row in rows[1:]:
        for k, _ in enumerate(labels):
            cell = row[k] if k < len(row) else ""
            for lemma in cell.split(",") if profile == "fused" else [cell]:
                if lemma.strip():
                    found.setdefault((lemma.strip(), k))
    return spark.createDataFrame([(x, labels[k], k) for x, k in found], LONG)


def from_cells(rows: DataFrame, labels: list[str], profile: str = "standard", cells_col: str = "cells") -> DataFrame:
    """from_rows of a table whose rows hold an array of cells, below a header with these labels; without repeats."""
    if not labels:
        raise ValueError("the group table is empty")
    kept = list(labels) if profile == "fused" else [c.strip() for c in labels if c.strip()]
    if len(set(kept)) < len(kept):
        raise ValueError("group labels must differ")
    if not kept:
        return rows.sparkSession.createDataFrame([], LONG)
    cells = rows.select(F.posexplode(F.slice(cells_col, 1, len(kept))).alias("group_pos", "cell"))
    if profile == "fused":
        cells = cells.select("group_pos", F.explode(F.split(filled("cell"), ",")).alias("cell"))
    names = F.array(*map(F.lit, kept))
    return cells.select(strip("cell").alias("lemma"), F.get(names, F.col("group_pos")).alias("group"), "group_pos").where("lemma != ''").distinct()


def read(spark: SparkSession, path: str, profile: str = "standard", encoding: str = "utf-8") -> DataFrame:
    """from_rows of a delimited file, or a folder of such files with one header."""
    header, cells = readers.cell_rows(spark, path, encoding=encoding)
    return from_cells(cells, header, profile)


def tags_long(matrix: DataFrame, ignore: list[str] | None = None, order_col: str = ROW_ORD) -> DataFrame:
    """row_ord, lemma, frequency, group, group_pos: the one tag of each usable row of a tag matrix.

    The matrix has lemma, frequency (or freq) and a column for each group; names are compared without case
    and blanks, ignored labels drop out. Rows are left out that have no lemma, no whole frequency, no tag 1,
    or more than one.
    """
    cols = [c for c in matrix.columns if c != order_col]
    if len(cols) < 3 or cols[0].strip().lower() != "lemma" or cols[1].strip().lower() not in ("frequency", "freq"):
        raise ValueError("columns must be lemma, frequency or freq, and one group at least")
    out_of = {x.strip().lower() for x in ignore or []}
    groups = [c for c in cols[2:] if c.strip() and c.strip().lower() not in out_of]
    cells = F.array(*(F.struct(F.lit(c.strip()).alias("group"), F.lit(k).alias("group_pos"), strip(f"`{c}`").alias("flag")) for k, c in enumerate(groups)))
    rows = matrix.select(order_col, strip(f"`{cols[0]}`").alias("lemma"), whole_number(f"`{cols[1]}`").alias("frequency"), F.filter(cells, lambda x: x["flag"] == "1").alias("x"))
    usable = rows.where((F.col("lemma") != "") & F.col("frequency").isNotNull() & (F.size("x") == 1))
    one = F.get("x", F.lit(0))
    return usable.select(order_col, "lemma", "frequency", one["group"].alias("group"), one["group_pos"].alias("group_pos"))


def odd_flags(matrix: DataFrame, order_col: str = ROW_ORD) -> DataFrame:
    """row_ord, group, flag of cells that are neither empty, 0, 1 nor #N/A: worth a warning."""
    cols = [c for c in matrix.columns if c != order_col][2:]
    cells = F.array(*(F.struct(F.lit(c.strip()).alias("group"), strip(f"`{c}`").alias("flag")) for c in cols))
    return matrix.select(order_col, F.explode(cells).alias("x")).select(order_col, "x.*").where(~F.col("flag").isin("", "0", "1", "#N/A"))


def tags_to_columns(tags: DataFrame, labels: list[str], order_col: str = ROW_ORD) -> DataFrame:
    """The ragged table of lemmas by group, in the matrix's order; a row for each rank."""
    from pyspark.sql import Window as W

    from verbatlas.operators.groups import ragged

    ranked = tags.withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy(order_col)))
    return ragged(ranked, labels, "group", "lemma", "rank")


def blank(c: str):
    return filled(c) == ""
