"""Counts by value, filters by count, exact samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from verbatlas.functions.text import ROW_ORD
from verbatlas.session import stash


def counts(df: DataFrame, field: str, order_col: str | None = None) -> DataFrame:
    """field, freq, most frequent first; ties by first appearance (order_col), or by value without it."""
    aggs = [F.count("*").alias("freq")] + ([F.min(order_col).alias("_first")] if order_col else [])
    out = df.groupBy(field).agg(*aggs).orderBy(F.desc("freq"), F.col("_first" if order_col else field))
    return out.drop("_first")


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    """How many different values, and rows; exact."""
    return df.agg(F.count_distinct(field).alias("unique_values"), F.count("*").alias("rows"))


def in_range(freq: Column, least: int | None, most: int | None) -> Column:
    """Bounds are inclusive; one of them is needed."""
    if least is None and most is None:
        raise ValueError("a least or a most count is needed")
    if any(x is not None and x < 1 for x in (least, most)):
        raise ValueError("counts must be 1 or more")
    if least is not None and most is not None and least > most:
        raise ValueError("the least count is above the most")
    out = F.lit(True)
    if least is not None:
        out = out & (freq >= least)
    if most is not None:
        out = out & (freq <= most)
    return out


def filter_by_count(df: DataFrame, field: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows whose value of field, as it is (case and blanks count), occurs within the bounds.

    Counts are aggregated before any shuffle and joined back, so that a value that holds a large share of
    the rows is not gathered in one task, as a window over the value would.
    """
    test = in_range(F.col("_freq"), least, most)
    passing = df.groupBy(F.col(field).alias("_value")).agg(F.count("*").alias("_freq")).where(test).select("_value")
    return df.join(passing, df[field].eqNullSafe(passing["_value"]), "left_semi")


def sample(df: DataFrame, n: int, key_col: str, seed: int | str = 0) -> DataFrame:
    """Exactly n rows, the same for the same seed: those with the smallest digests of seed and key.

    The choice is a top-n, so no more than n rows of each task travel. A null key has a digest of its own.
    Rows with equal keys are told apart by a hash of their other columns; maps are left out of it.
    """
    if n < 0:
        raise ValueError("n must be 0 or more")
    total = df.count()
    if n > total:
        raise ValueError(f"a sample of {n} from {total} rows")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key_col).cast("string"), F.lit("\x00null"))))
    rest = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return df.withColumns({"_draw": draw, "_rest": F.xxhash64(*rest)}).orderBy("_draw", key_col, "_rest").limit(n).drop("_draw", "_rest")


def sample_like_python(df: DataFrame, n: int, seed: int | None = None, order_col: str = ROW_ORD) -> DataFrame:
    """The rows that random.Random(seed).sample picks, in input order. Places are drawn on the driver (n of them).

    order_col must number the rows from 0 without gaps.
    """
    total = df.count()
    if not 0 <= n <= total:
        raise ValueError(f"a sample of {n} from {total} rows")
    places = random.Random(seed).sample(range(total), n)
    chosen = df.sparkSession.createDataFrame([(p,) for p in places], f"{order_col} long")
    return df.join(F.broadcast(chosen) if n <= 1_000_000 else chosen, order_col, "left_semi").orderBy(order_col)


#: Consecutive places of the order that are numbered together.
RUN_BLOCK = 65_536


def running_count(df: DataFrame, field: str, order_col: str, out_col: str) -> DataFrame:
    """How often the row's value was seen so far, itself included, in the order of a column of any type that has one.

    Each value's rows are numbered in blocks of the order, and running sums of the blocks' counts are added, so that a very
    common value is not numbered by one task. Blocks are RUN_BLOCK places of an integer column, else ranges of the
    column as Spark cuts them (df is written then, as cutting passes it twice, and so are the ranges).
    """
    if isinstance(df.schema[order_col].dataType, IntegralType):
        cut = df.withColumn("_block", F.floor(F.col(order_col) / RUN_BLOCK))
    else:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cut = stash(stash(df).repartitionByRange(ranges, order_col).withColumn("_block", F.spark_partition_id()))
    sizes = cut.groupBy(F.col("_block").alias("_b"), F.col(field).alias("_f")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("_f").orderBy("_b")) - F.col("_n")).drop("_n")
    own = cut.withColumn("_own", F.row_number().over(W.partitionBy(field, "_block").orderBy(order_col)))
    out = own.join(before, (own["_block"] == before["_b"]) & own[field].eqNullSafe(before["_f"]))
    return out.select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(out_col))
