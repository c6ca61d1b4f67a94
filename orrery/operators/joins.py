"""Join operators: preferences, grids, fallbacks, as-of, null-safe and bounded theta joins.

Sides are never broadcast by hint: Spark's own size check and adaptive execution
choose, and split skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import keep_first, top


def first_leader(followers: DataFrame, leaders: DataFrame, on: str, follower: str, leader: str, order: Sequence[str]) -> DataFrame:
    """Each follower with its first leader, and whether there were several.

    Leaders are cut down to the first of each `on` before the join, so that it makes
    a row for each row of followers and not for each pair.
    """
    own = [c for c in leaders.columns if c != on]
    first = F.min_by(F.struct(*own), F.struct(*[c for c in order if c in leaders.columns])).alias("_first")
    by = leaders.groupBy(on).agg(first, F.min(leader).alias("_least"), F.max(leader).alias("_most"))
    both = followers.join(by, on).select(*followers.columns, "_first.*", "_least", "_most")
    same = Window.partitionBy(follower)
    several = F.coalesce(F.min("_least").over(same) < F.max("_most").over(same), F.lit(False))
    return keep_first(both.withColumn("conflict", several).drop("_least", "_most"), [follower], order)


def fallback(left: DataFrame, right: DataFrame, on: str, by: str, default: str, value: Sequence[str]) -> DataFrame:
    """right's values for (on, by), else for (on, default), else for on's first `by`; nulls where on is unknown."""
    exact = right.select(on, by, *[F.col(v).alias(f"_exact_{v}") for v in value], F.lit(1).alias("_exact"))
    usual = right.filter(F.col(by) == default).select(on, *[F.col(v).alias(f"_usual_{v}") for v in value], F.lit(1).alias("_usual"))
    other = right.groupBy(on).agg(*[F.min_by(v, by).alias(f"_any_{v}") for v in value])
    out = left.join(exact, [on, by], "left").join(usual, on, "left").join(other, on, "left")
    picks = {v: F.when(F.col("_exact") == 1, F.col(f"_exact_{v}")).when(F.col("_usual") == 1, F.col(f"_usual_{v}")).otherwise(F.col(f"_any_{v}")) for v in value}
    via = F.when(F.col("_exact") == 1, "exact").when(F.col("_usual") == 1, "default").when(F.coalesce(*[F.col(f"_any_{v}") for v in value]).isNotNull(), "any")
    return out.withColumns(picks | {"matched": via}).select(*left.columns, *value, "matched")


def zero_filled(df: DataFrame, group: str, low: int, high: int, step: str, values: Sequence[str]) -> DataFrame:
    """A row for each group and step from low to high; absent values are 0. Each group makes its own grid."""
    grid = df.select(group).distinct().select(group, F.explode(F.sequence(F.lit(low), F.lit(high))).alias(step))
    return grid.join(df, [group, step], "left").fillna(0, list(values))


def pairs_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """Unordered pairs of the members of each (small) group."""
    a, b = df.select(group, F.col(order).alias("a")), df.select(group, F.col(order).alias("b"))
    return a.join(b, group).filter("a < b")


def unseen(new: DataFrame, known: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of new that known lacks, nulls being equal to nulls; of equal new rows the first."""
    other = known.select(*[F.col(c).alias(f"_k_{c}") for c in on]).distinct()
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on])
    return keep_first(new, list(on), list(order)).join(other, same, "left_anti")


def best_trades(sells: DataFrame, buys: DataFrame, on: str, n: int, keep: int, ask: str = "ask", bid: str = "bid", sell_key: str = "seller", buy_key: str = "buyer") -> DataFrame:
    """The n lowest asks with the n highest bids of each item, where they leave a spread; the `keep` widest."""
    low = top(sells, [on], [F.col(ask), F.col(sell_key)], n, "_s").drop("_s")
    high = top(buys, [on], [F.col(bid).desc(), F.col(buy_key)], n, "_b").drop("_b")
    lanes = low.join(high, on).withColumn("spread", F.col(bid) - F.col(ask)).filter("spread > 0")
    return top(lanes, [on], [F.col("spread").desc(), F.col(sell_key), F.col(buy_key)], keep, "lane")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, value: str, name: str) -> DataFrame:
    """Each row of left with the last value of right at or before its time: one union and one window, no range join."""
    l = left.withColumns({"_value": F.lit(None).cast(dict(right.dtypes)[value]), "_left": F.lit(1)})
    r = right.select(*on, time, F.col(value).alias("_value"), F.lit(0).alias("_left"))
    w = Window.partitionBy(*on).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r, allowMissingColumns=True).withColumn(name, F.last("_value", True).over(w)).filter("_left = 1").drop("_value", "_left")


def positions(sides: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of sums by key; absent amounts are 0."""
    out = reduce(lambda a, b: a.join(b, list(on), "full_outer"), sides.values())
    return out.fillna(0, [c for c in out.columns if c not in on])


def member(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """df with a flag of whether its key is in keys."""
    return df.join(keys.select(*on).distinct().withColumn(name, F.lit(1)), list(on), "left").fillna(0, [name])
