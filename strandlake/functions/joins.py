"""Joins whose sides grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left and right joined by sorting, never by a broadcast.

    Spark takes a table's size from its columns in the file, before rows are multiplied or a checkpoint
    is read: it would send tables of any size through the driver.
    """
    return left.join(right.hint("merge"), on, how)
