"""Exact quantiles in bounded memory: a sketch cuts each group into ranges, counts find the ranges of the ranks, and only these are ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group is cut into; each is ordered by a task of its own.
RANGES = 64


def exact(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, names of at): for each group the value at each share (0 to 1) of its order, interpolated between neighbours.

    Null values don't count, groups of these alone are left out; null keys are keys.
    Without keys the result is a row, or none for an empty table. Equal values are
    counted before the shuffle, so that a common one is no heavier than a rare one.
    """
    own = [f"_k{i}" for i in range(len(keys))] or ["_all"]
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(keys, own)], *([] if keys else [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v"))
    hist = rows.groupBy(*own, "_v").agg(F.count("*").alias("_n"))
    cuts = rows.groupBy(*own).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 2000).alias("_cuts"), F.count("*").alias("_of"))
    same = [F.col(o).eqNullSafe(F.col(f"_c{o}")) for o in own]

    def with_(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        right = right.select(*[F.col(o).alias(f"_c{o}") for o in [*own, *more]], *[c for c in right.columns if c not in [*own, *more]])
        on = [*same, *[F.col(m) == F.col(f"_c{m}") for m in more]]
        return left.join(right, on).drop(*[f"_c{o}" for o in [*own, *more]])

    dealt = with_(hist, cuts).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sums = dealt.groupBy(*own, "_range").agg(F.sum("_n").alias("_has"), F.max("_of").alias("_of"))
    sums = sums.withColumn("_before", F.sum("_has").over(Window.partitionBy(*own).orderBy("_range")) - F.col("_has"))  # at most RANGES rows of a group
    place = {n: (F.col("_of") - 1) * F.lit(float(p)) for n, p in at.items()}
    ranks = F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place.values()]))
    sums = sums.filter(F.exists(ranks, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_has")))).select(*own, "_range", "_before")
    near = with_(dealt, sums, "_range").withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*own, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    holds = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col("_v")))
    ends = near.groupBy(*own, "_of").agg(*[holds(f(x)).alias(f"_{e}{i}") for i, x in enumerate(place.values()) for e, f in (("lo", F.floor), ("hi", F.ceil))])
    out = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (x - F.floor(x))).alias(n) for i, (n, x) in enumerate(place.items())]
    return ends.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], *out)
