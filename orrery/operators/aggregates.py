"""Aggregate operators with the reference's null, tie and rounding rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import clamp

from .quantiles import exact
from .windows import keep_first


def presence(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Row counts by keys; a null key counts as the empty text."""
    return df.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def market(df: DataFrame, keys: Sequence[str], price: str, amount: str) -> DataFrame:
    """Offers, amount and price band by place, item and side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("offers"), F.sum(amount).alias("amount"), F.min(price).alias("price_min"), F.avg(price).alias("price_avg"), F.max(price).alias("price_max"))


def standing(df: DataFrame, keys: Sequence[str], kind: str, value: str) -> DataFrame:
    """Boosters replace the base where there are any; clamped to [-1, 1]; pairs with neither are left out."""
    known = df.filter(F.col(kind).isin("base", "booster"))
    total = {k: F.sum(F.when(F.col(kind) == k, F.col(value)).otherwise(0.0)) for k in ("base", "booster")}
    out = known.groupBy(*keys).agg(total["base"].alias("base"), total["booster"].alias("booster"), F.max(F.col(kind) == "booster").alias("_boosted"))
    return out.withColumn("effective", clamp(F.when(F.col("_boosted"), F.col("booster")).otherwise(F.col("base")), -1.0, 1.0)).drop("_boosted")


def of_least(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The least of order for each key, with the other values of that row."""
    return df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(v, order).alias(v) for v in values])


def wide(df: DataFrame, keys: Sequence[str], by: str, names: Sequence, value: Column, fill: float | None = 0) -> DataFrame:
    """Sums as one column for each named kind. The kinds are given, so Spark needs no pass to find them."""
    out = df.groupBy(*keys).pivot(by, list(names)).agg(F.sum(value))
    return out if fill is None else out.fillna(fill)


def mode(df: DataFrame, keys: Sequence[str], value: str, order: str, name: str = "mode") -> DataFrame:
    """The most frequent value; of equally frequent ones that which comes first."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(name), F.max("_n").alias(f"{name}_n"))


def hierarchy(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Positive sums at every prefix of the levels, with the level and the percentage of all."""
    total = df.filter(F.col(value) > 0).rollup(*levels).agg(F.sum(value).alias("total"), F.grouping_id().alias("gid"))
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("gid"), F.lit("0"), F.lit("")))
    return total.withColumn("depth", depth.cast("int")).drop("gid").filter("total > 0")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact, interpolated quantiles of positive values."""
    return exact(df.filter(F.col(value) > 0), keys, value, at)


def binned_rms(df: DataFrame, x: str, y: str, low: float, high: float, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Root mean square of the medians of y in n equal, right-closed bins of x, by keys; values outside count to the end bins."""
    k = F.least(F.lit(n), F.greatest(F.lit(1), F.ceil((F.col(x) - low) / ((high - low) / n)))).cast("int")
    return _rms(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bin", k), y, keys)


def _rms(binned: DataFrame, y: str, keys: Sequence[str]) -> DataFrame:
    by = [*keys, "bin"]
    bins = exact(binned, by, y, {"m": 0.5}).join(binned.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    return bins.groupBy(*keys).agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("rms"), F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n"))


def equal_count_rms(df: DataFrame, x: str, y: str, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Root mean square of the medians of y in n right-closed bins of equal counts of x, by keys (not null); bins of equal edges are one."""
    some = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = exact(some, keys, x, {f"_e{k}": k / n for k in range(n + 1)}).select(*keys, F.array_distinct(F.array(*[f"_e{k}" for k in range(n + 1)])).alias("_edges"))
    bins = some.join(edges, list(keys)) if keys else some.join(F.broadcast(edges), F.lit(True))  # without keys one row
    return _rms(bins.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < F.col(x))))), y, keys)


def earnings(df: DataFrame, keys: Sequence[str], money: str, amount: str, hours: float) -> DataFrame:
    """Totals and ratios of trades, largest first; ratios are rounded half to even."""
    a = df.groupBy(*keys).agg(F.sum(money).alias("total"), F.count(F.lit(1)).alias("trades"), F.sum(amount).alias("units"))
    return a.select(*keys, F.bround("total", 2).alias("total"), "trades", "units", F.bround(F.col("total") / F.col("trades"), 2).alias("per_trade"), F.bround(F.col("total") / F.nullif("units", F.lit(0.0)), 2).alias("per_unit"), F.bround(F.col("total") / hours, 2).alias("per_hour")).orderBy(F.col("total").desc(), *keys)


def digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One value that changes when any row does: the number of rows and a sum of their hashes, whatever their order."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def relabelled(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Alike members as one row: the first label, or its count and `x` before it."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("_label"))
    return g.select(*keys, "n", F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit("x "), F.col("_label"))).otherwise(F.col("_label")).alias("label"))


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, order)


def unpivoted(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)
