"""Rows that a step cannot use: told apart, counted and kept with their reason, in the one job that reads the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from verbatlas.session import stash

REASON = "reason"


def reasoned(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """rows with reason: the first of the tests that is true; null for rows that can be used. A test that is null is not true."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        out = F.when(test, name).otherwise(out)
    return rows.withColumn(REASON, out)


class Checked:
    """Rows by their tests, written once. `usable` and `dead` are read from what was written; `counts` were observed meanwhile.

    counts: rows_read, and for each test how many rows failed it first.
    """

    def __init__(self, rows: DataFrame, tests: dict[str, Column]):
        seen = Observation()
        failed = [F.count(F.when(F.col(REASON) == name, 1)).alias(f"c{k}") for k, name in enumerate(tests)]
        self._rows = stash(reasoned(rows, tests).observe(seen, F.count(F.lit(1)).alias("n"), *failed))
        found = seen.get
        self.counts = {"rows_read": found["n"]} | {name: found[f"c{k}"] for k, name in enumerate(tests)}

    @property
    def usable(self) -> DataFrame:
        return self._rows.where(F.col(REASON).isNull()).drop(REASON)

    @property
    def dead(self) -> DataFrame:
        return self._rows.where(F.col(REASON).isNotNull())
