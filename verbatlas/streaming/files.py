"""Verb counts over a folder that keeps growing: a file stream, extraction without state, counts by foreachBatch.

The analysis itself is bounded. This is the form for text that arrives over time: each micro-batch is
extracted like a table, and its counts are added to a table of counts by batch, so that a batch that is
run again after a failure replaces its own counts and adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbatlas.operators import extract
from verbatlas.session import spread

SCHEMA = "doc_id string, text string"


def document_stream(spark: SparkSession, folder: str, fmt: str = "json", schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """Rows of the files that come into a folder."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def verb_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", include_aux: bool = True) -> DataFrame:
    """Verb occurrences of a stream of documents. Stateless: sentences are cut in each document."""
    found = extract.sentences(docs.select(id_col, text_col).withColumn("chunk_start", F.lit(0).cast("long")), text_col)
    return extract.verbs(found, include_aux=include_aux)


def unique_stream(docs: DataFrame, keys: list[str], time_col: str, horizon: str) -> DataFrame:
    """Rows without repeats of the keys within a horizon of event time; the state is bounded by it."""
    return docs.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_counts(verbs: DataFrame, time_col: str, window: str, late: str) -> DataFrame:
    """window, lemma, freq: counts in windows of event time; rows later than `late` drop out."""
    return verbs.withWatermark(time_col, late).groupBy(F.window(time_col, window), "lemma").agg(F.count("*").alias("freq"))


def count_into(verbs: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Counts of each micro-batch, written to target as Parquet by batch number."""

    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("lemma").agg(F.count("*").alias("freq"))
        counts.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = verbs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def count_verbs_into(docs: DataFrame, target: str, checkpoint: str, text_col: str = "text", include_aux: bool = True, available_now: bool = True) -> StreamingQuery:
    """count_into of a stream of documents: verbs are told among each micro-batch's distinct words, over all cores."""

    def add(batch: DataFrame, number: int) -> None:
        counts = extract.verb_counts(spread(batch.select(text_col)), "lemma", text_col, include_aux=include_aux)
        counts.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts_so_far(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("lemma").agg(F.sum("freq").alias("freq"))
