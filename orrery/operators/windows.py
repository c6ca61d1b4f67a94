"""Window operators over series: flows, epochs, moving averages, fills, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import greatest_null


def epochs(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], gap_s: float, name: str = "epoch") -> DataFrame:
    """Number of gaps longer than gap_s so far in each series; time in seconds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_gap", F.when(F.col(time) - F.lag(time).over(w) > gap_s, 1).otherwise(0)).withColumn(name, F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def flows(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str) -> DataFrame:
    """inflow and outflow of a level against the row before in its series; null on the first row, never negative."""
    before = F.lag(level).over(Window.partitionBy(*keys).orderBy(*order))
    delta = F.col(level) - before
    return df.withColumns({"delta": delta, "inflow": greatest_null(delta, F.lit(0.0)), "outflow": greatest_null(-delta, F.lit(0.0))})


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """Centred mean of n rows, null where fewer are there."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n // 2), (n - 1) // 2)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == n, F.avg(value).over(w)))


def fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The last known value, or before any the first that follows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.coalesce(back, F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last in order."""
    return top(df, keys, [F.col(c).desc() for c in order], 1, "_k").drop("_k")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top(df, keys, [F.col(c).asc() for c in order], 1, "_k").drop("_k")


def midrank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Share of smaller values plus half the share of equal ones, among values other than zero."""
    ranked, same, every = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value), Window.partitionBy(*keys)
    known = df.filter((F.col(value) != 0) & F.col(value).isNotNull())
    return known.withColumn(name, (F.rank().over(ranked) - 1 + F.count(F.lit(1)).over(same) / 2) / F.count(F.lit(1)).over(every))


def share(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Basis points of the group's total, half to even, for positive values."""
    return df.withColumn(name, F.bround(10000 * F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))).filter(F.col(name) > 0)


def normalised(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value over the group's greatest, which counts as 1 where it is 0."""
    most = F.max(value).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.col(value) / F.coalesce(F.nullif(most, F.lit(0.0)), F.lit(1.0)))


def option_weight(df: DataFrame, keys: Sequence[str], name: str = "weight") -> DataFrame:
    return df.withColumn(name, F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, name: str = "offset") -> DataFrame:
    """Where each member of an archive starts: the sizes before it."""
    return running(df, keys, order, size, "_upto").withColumn(name, F.col("_upto") - F.col(size)).drop("_upto")
