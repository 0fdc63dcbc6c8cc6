"""Gaps and islands: one window pass numbers the runs of an ordered group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.exprs import seconds_between


def number_runs(df: DataFrame, keys: list[str], order: list[str], breaks: Callable[[Column], Column], seen: list[str], name: str) -> DataFrame:
    """Add ``name``: the run of each row in its group.

    ``breaks(previous)`` says whether a row starts a run, given the struct of
    the columns ``seen`` of the row before; a group's first row always does.
    Where it is null the row is in no run.  Both window functions share one
    sort, and every later window or group by ``keys`` and ``name`` reuses the
    shuffle.
    """
    line = Window.partitionBy(*keys).orderBy(*order)
    previous = F.lag(F.struct(*seen)).over(line)
    flagged = df.withColumn("_previous", previous)
    first = F.col("_previous").isNull()
    flagged = flagged.withColumn("_break", F.when(first, True).otherwise(breaks(F.col("_previous"))))
    run = F.sum(F.coalesce(F.col("_break").cast("int"), F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn(name, F.when(F.col("_break").isNotNull(), run)).drop("_previous", "_break")


def time_gap(previous: Column, seconds: float, time: str = "timestamp") -> Column:
    return seconds_between(F.col(time), previous[time]) > seconds
