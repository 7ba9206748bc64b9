"""Helpers about the running SparkSession: shipping the package, cutting lineage, reading tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="verbatlas-")) / "verbatlas_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def _shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints. Only on one machine, as in tests, a temporary one stands in where none is set."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "verbatlas-checkpoints"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def stash(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder.

    Checkpoints go when they are no longer referred to, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder; nothing is there yet."""
    return f"{_shared_folder(spark)}/{uuid.uuid4().hex}"


def local_scratch(spark: SparkSession) -> Path:
    """A new folder in the shared folder that Python's own file functions reach."""
    path = scratch(spark)
    if "://" in path.replace("file:///", "/"):
        raise RuntimeError(f"{path} is not on this machine")
    found = Path(re.sub("^file:/+", "/", path))
    found.mkdir(parents=True)
    return found


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again."""
    target = f"{scratch(df.sparkSession)}.parquet"
    df.write.parquet(target)
    return df.sparkSession.read.parquet(target)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `written` gave, once nothing reads it any more."""
    spark = df.sparkSession
    folder = _shared_folder(spark)
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        if re.sub("^file:/+", "/", name).startswith(re.sub("^file:/+", "/", folder) + "/"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files come in fewer pieces; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bits (as a power of two) of the marks that may_match sends to all tasks, at most: 2^20 words of 64.
MARK_BITS = 26


def may_match(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows without most of those whose keys are not among wanted's, so that fewer meet it in an exact join, which must follow.

    A key of wanted sets one of 8 to 16 bits for each (fewer beyond 2^MARK_BITS); the words of bits are broadcast.
    """
    bits = min(MARK_BITS, max(6, (8 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    marks = wanted.select(place.alias("_p")).groupBy(F.expr("shiftright(_p, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_p & 63 as int)))").alias("_marks"))
    met = rows.withColumn("_p", place).join(F.broadcast(marks), F.expr("shiftright(_p, 6) = _word"))
    return met.where("shiftright(_marks, cast(_p & 63 as int)) & 1 = 1").select(*rows.columns)
