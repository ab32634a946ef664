"""Joining rows to a summary of them, such as one value a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.session import known_empty, materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def measure(summary: DataFrame, label: str = "summary") -> tuple[DataFrame, bool]:
    """The summary, computed and written to the scratch folder when this is called, and whether it is small.

    Its size is then known rather than guessed: within the bounds it is marked for broadcast. Beyond them
    the join is left to Spark (sort-merge, with adaptive splitting of skewed keys); the rows are the same.
    """
    if known_empty(summary):
        return summary, True
    table = materialize(summary, label)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS
    return (F.broadcast(table) if small else table), small


def measured(summary: DataFrame, label: str = "summary") -> DataFrame:
    return measure(summary, label)[0]


def join_summary(rows: DataFrame, summary: DataFrame, keys: list[str], how: str = "inner",
                 label: str = "summary") -> DataFrame:
    """``rows`` joined to a ``measured`` summary: no shuffle of the rows as long as it is small."""
    return rows.join(measured(summary, label), keys, how)
