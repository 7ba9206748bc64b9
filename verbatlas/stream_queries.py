"""Registered queries on streams with state, and their SQL.

Each table comes as a stream in three parts by the order of its ids. The stream is stopped after each part and started again on
its checkpoint, so a result has passed two restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbatlas.session import scratch, table
from verbatlas.streaming import stateful

WINDOW = 3


def _in_three_parts(rows: DataFrame, order_col: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Adds the thirds of a table to a folder and lets `start(stream of the folder)` run to its end after each."""
    folder = scratch(rows.sparkSession)
    least, most = rows.agg(F.min(order_col), F.max(order_col)).first()
    third = F.lit(0) if least is None else F.expr(f"(`{order_col}` - {least}) * 3 div {most - least + 1}")
    for k in range(3):
        rows.where(F.coalesce(third, F.lit(0)) == k).write.mode("append").parquet(folder)
        start(rows.sparkSession.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


def stream_bounded_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose kind their user has not had among the last kinds remembered."""
    target, checkpoint = scratch(spark), scratch(spark)
    unique = lambda s: stateful.bounded_unique_stream(s, ["user_id"], ["event_type"], "event_id", WINDOW)
    _in_three_parts(_events(spark, sf_dir), "event_id", lambda s: stateful.append_into(unique(s), target, checkpoint))
    return spark.read.parquet(target).drop("batch")


def stream_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with how often its kind was seen so far."""
    target, checkpoint = scratch(spark), scratch(spark)
    counted = lambda s: stateful.running_count_stream(s.select("event_id", "event_type"), "event_type", "event_id", "seen")
    _in_three_parts(_events(spark, sf_dir), "event_id", lambda s: stateful.append_into(counted(s), target, checkpoint))
    return spark.read.parquet(target).drop("batch")


def stream_freq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """freq_filter_range over line items that keep coming: rows are released and retracted as their part's count grows."""
    target, checkpoint = scratch(spark), scratch(spark)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    _in_three_parts(rows, "l_orderkey", lambda s: stateful.filter_into(s, "l_partkey", target, checkpoint, least=20, most=28))
    return stateful.kept_so_far(spark, target)


QUERIES = {f.__name__: f for f in (stream_bounded_dedupe, stream_running_count, stream_freq_filter)}
ORACLE_SQL = {
    "stream_bounded_dedupe": f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
m AS (
  SELECT event_id, user_id, event_type, place, true AS kept, [event_type] AS held FROM e WHERE place = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.event_type, e.place, NOT list_contains(m.held, e.event_type),
    CASE WHEN list_contains(m.held, e.event_type) THEN m.held WHEN len(m.held) = {WINDOW} THEN list_append(m.held, e.event_type)[2:] ELSE list_append(m.held, e.event_type) END
  FROM m JOIN e ON e.user_id = m.user_id AND e.place = m.place + 1)
SELECT event_id, user_id, event_type FROM m WHERE kept""",
    "stream_running_count": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seen FROM events",
    "stream_freq_filter": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) BETWEEN 20 AND 28)",
}
