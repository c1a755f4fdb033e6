"""Dealing rows over tasks before work in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all tasks of a shuffle, for work in Python on tables of few files, or behind joins whose small results are merged into few tasks."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism))


#: Rows of one task that joins and aggregates hold in memory, about; some hundred bytes each and step.
ROWS_A_TASK = 1 << 18


def tasks_for(rows: int) -> int:
    """Into how many tasks ``rows`` rows are dealt by key, so that what one holds does not grow with them."""
    return rows // ROWS_A_TASK + 1


def dealt_by(df: DataFrame, key: list[str], tasks: int | None) -> DataFrame:
    """The rows dealt by ``key`` into so many tasks; unchanged without a number.

    Partitions of a stated number are not merged.  Others are merged by their compressed bytes, which for sorted numbers are
    few, so that a task would get many millions of rows.  Joins and groupings by the key then need no exchange of their own.
    """
    return df if tasks is None else df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *key)
