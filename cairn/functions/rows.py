"""How rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task, at most about so many.
TASK_ROWS = 50_000


def tasks(rows: DataFrame, most: int = TASK_ROWS) -> int:
    """As many tasks as can run, and more if ``rows`` would be more than ``most`` a task."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // most + 1)


def dealt(rows: DataFrame, *by: str, most: int = TASK_ROWS) -> DataFrame:
    """``rows`` dealt by the columns ``by``: a small file is read by one task, whatever is then made of its rows."""
    return rows.repartition(tasks(rows, most), *by)
