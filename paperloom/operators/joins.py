"""Joins that equality alone does not express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Rows with the ranges whose ``low`` up to ``high`` holds their ``value``; a row in several ranges comes several times, one in none not at all.

    Values and ranges meet by cells of a ``width``: a range is given to each
    cell it touches, so that the join is by equality and no pair outside of a
    cell is made. The width should be near that of most ranges. Nulls are in no
    range, and an upside-down range holds nothing.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return rows.withColumn("_cell", cell(value)).join(spread, "_cell").where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("_cell")


def checked_broadcast_join(rows: DataFrame, small: DataFrame, on: list[str], most: int, how: str = "inner") -> DataFrame:
    """A join that sends ``small`` to every task if it has at most ``most`` rows, and else shuffles both sides as any join does.

    One row more than that many is counted, never all of a large side.
    """
    fits = small.limit(most + 1).count() <= most
    return rows.join(F.broadcast(small) if fits else small, on, how)
