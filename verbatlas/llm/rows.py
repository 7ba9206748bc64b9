"""Carrying the rows of any table through an operator, whatever its columns are called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The column that holds a whole row; `select(f"{ROW}.*")` gives it back.
ROW = "row"


def named(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row() -> Column:
    """All columns as one, so that columns made beside it cannot clash with them."""
    return F.struct("*").alias(ROW)
