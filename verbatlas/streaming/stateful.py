"""Streams that remember: bounded deduplication, running counts, and a frequency filter over input that keeps growing.

State lives in Spark's state store or in tables by batch number, both below the checkpoint, so a query that is stopped or lost
goes on where it was, and a batch that runs again replaces what it wrote. Rows of one key count in the order of
`order_col` within a batch, and batch after batch. What a task holds of a key is one batch's rows, narrow; the
size of a batch (`maxFilesPerTrigger` of the source) bounds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from verbatlas.operators.frequency import in_range
from verbatlas.session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(rows: DataFrame, keys: list[str], processor: Callable[[dict[str, str]], StatefulProcessor], time_mode: str = "none", more: dict[str, Column] | None = None, out: str | None = None) -> DataFrame:
    """rows through a processor that sees a group for each value of the keys; `more` are columns for it alone, `out` is one of its own.

    Columns go by plain names on the way, as pandas' rows give other names to some.
    """
    ship(rows.sparkSession)
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    plain = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *(x.alias(n) for n, x in (more or {}).items()))
    kinds = [f"{names[f.name]} {f.dataType.simpleString()}" for f in rows.schema] + (["made long"] if out else [])
    done = plain.groupBy(*(names[k] for k in keys)).transformWithStateInPandas(processor(names), ", ".join(kinds), "Append", time_mode)
    return done.toDF(*rows.columns, *([out] if out else []))


class BoundedMemory(StatefulProcessor):
    """Passes a key's rows whose item is not held; of more than `window` items the oldest tenth is forgotten.

    An item seen again keeps its place: it is forgotten when its first sight is the oldest. With `idle_ms` a key that no
    row came for is forgotten whole once the watermark is that far beyond its last row.
    """

    def __init__(self, order_col: str, window: int, time_col: str | None = None, idle_ms: int | None = None):
        self.order_col, self.window, self.time_col, self.idle_ms = order_col, window, time_col, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "item string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.order_col, kind="stable")
        held: dict[str, None] = dict.fromkeys(x[0] for x in self.held.get()) if self.held.exists() else {}
        keep = np.zeros(len(frame), bool)
        for at, item in enumerate(frame["item"]):
            if item in held:
                continue
            held[item] = None
            keep[at] = True
            if len(held) > self.window:
                for old in [x for x, _ in zip(held, range(max(1, self.window // 10)), strict=False)]:
                    del held[old]
        if keep.any():
            self.held.put([(x,) for x in held])
        if self.idle_ms is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            last = int(pd.to_datetime(frame[self.time_col]).max().timestamp() * 1000)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield frame[keep].drop(columns="item")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def bounded_unique_stream(rows: DataFrame, keys: list[str], items: list[str], order_col: str, window: int, time_col: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """The rows of a stream whose items their key does not remember; memory holds `window` items of each key.

    This is `extract.bounded_unique_sentences` for input without end. idle_ms needs time_col with a watermark.
    """
    if window < 1:
        raise ValueError("the window must be 1 or more")
    if (idle_ms is None) != (time_col is None):
        raise ValueError("idle_ms and time_col go together")
    item = F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(items))))
    memory = lambda names: BoundedMemory(names[order_col], window, time_col and names[time_col], idle_ms)
    return _with_state(rows, keys, memory, "none" if idle_ms is None else "EventTime", {"item": item})


class RunningCount(StatefulProcessor):
    """Numbers a key's rows, on from the number that it has reached."""

    def __init__(self, order_col: str):
        self.order_col = order_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.order_col, kind="stable")
        first = self.reached.get()[0] if self.reached.exists() else 0
        self.reached.update((first + len(frame),))
        frame["made"] = np.arange(first + 1, first + 1 + len(frame), dtype=np.int64)
        yield frame

    def close(self) -> None:
        pass


def running_count_stream(rows: DataFrame, field: str, order_col: str, out_col: str) -> DataFrame:
    """rows (narrow) with out_col: how often the row's value was seen so far, itself included, over all batches.

    `frequency.running_count` for input without end. The state is one number for each value.
    """
    return _with_state(rows, [field], lambda names: RunningCount(names[order_col]), out=out_col)


def append_into(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """What a stream with state puts out, as Parquet by batch number. Started again with the same checkpoint it goes on."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        return stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


# -- a frequency filter over growing input --------------------------------------------------------
def _earlier(spark: SparkSession, path: str, number: int, empty: DataFrame) -> DataFrame:
    """The rows of the batches before `number`; of a batch that runs again nothing is seen."""
    try:
        return spark.read.parquet(path).where(F.col("batch") < number).select(*empty.columns)
    except AnalysisException:  # nothing was written yet
        return empty.limit(0)


def filter_into(rows: DataFrame, field: str, target: str, checkpoint: str, least: int | None = None, most: int | None = None) -> StreamingQuery:
    """Changes to the rows whose value of field occurs within the bounds, as input comes: `kept_so_far` adds them up.

    Each batch adds its counts to the table of counts by batch. A value that comes to pass releases its earlier rows; one that
    grows past `most` retracts them; rows of a value that stays within the bounds follow at once. Only values of the batch are
    looked up, and counts are aggregated before they meet rows, so that a common value gathers no rows anywhere.
    """
    test = lambda n: in_range(F.col(n), least, most)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        value = F.col(field).alias("_value")
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        now = spark.read.schema(batch.schema).parquet(f"{target}/rows/batch={number}")
        own = now.groupBy(value).agg(F.count("*").alias("_n"))
        own.write.mode("overwrite").parquet(f"{target}/counts/batch={number}")
        own = spark.read.schema(own.schema).parquet(f"{target}/counts/batch={number}")
        past = _earlier(spark, f"{target}/counts", number, own).withColumnRenamed("_value", "_v")
        before = own.join(past, own["_value"].eqNullSafe(past["_v"])).groupBy("_value").agg(F.sum(past["_n"]).alias("_b"))
        before = before.withColumnRenamed("_value", "_v")
        both = own.join(before, own["_value"].eqNullSafe(before["_v"]), "left").select("_value", F.coalesce("_b", F.lit(0)).alias("_b"))
        both = both.join(own.withColumnRenamed("_value", "_v"), F.col("_value").eqNullSafe(F.col("_v"))).select("_value", "_b", (F.col("_b") + F.col("_n")).alias("_a"))
        state = both.select("_value", ((F.col("_b") > 0) & test("_b")).alias("_was"), test("_a").alias("_is"))
        old = _earlier(spark, f"{target}/rows", number, now)
        released = old.join(state.where("_is and not _was"), F.col(field).eqNullSafe(F.col("_value")), "left_semi").withColumn("change", F.lit(1))
        retracted = old.join(state.where("_was and not _is"), F.col(field).eqNullSafe(F.col("_value")), "left_semi").withColumn("change", F.lit(-1))
        followed = now.join(state.where("_is"), F.col(field).eqNullSafe(F.col("_value")), "left_semi").withColumn("change", F.lit(1))
        released.union(retracted).union(followed).write.mode("overwrite").parquet(f"{target}/changes/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_so_far(spark: SparkSession, target: str) -> DataFrame:
    """The rows that pass after the last batch: each as often as it was released and not retracted."""
    changes = spark.read.parquet(f"{target}/changes").drop("batch")
    names = [c for c in changes.columns if c != "change"]
    left = changes.groupBy(*names).agg(F.sum("change").alias("_n")).where("_n > 0")
    return left.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_k")).drop("_k")
