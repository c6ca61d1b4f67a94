"""Modifications of the rules: which are at work, and what they put in place of recipes and capacities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import to_double

#: Fixed value: how much over its ceiling an efficiency has to be.
EPS = 1e-6


def detected(mods: DataFrame, extensions: DataFrame, production: DataFrame, recipes: DataFrame) -> DataFrame:
    """(mod, by) of mods (mod, ware) that are at work: a snapshot names them among its extensions (id), or a module makes their ware (ware, efficiency) better than any recipe of it (ware, work_effect) allows.

    Without recipes of the ware, or without that column, an efficiency tells nothing.
    """
    named = extensions.select(F.col("id").alias("mod")).distinct().withColumn("_named", F.lit(True))
    out = mods.select("mod", "ware").distinct().join(named, "mod", "left")
    if "work_effect" in recipes.columns:
        ceiling = recipes.groupBy("ware").agg((1 + F.max(F.coalesce(to_double("work_effect"), F.lit(0.0)))).alias("_most"))
        made = production.groupBy("ware").agg(F.max("efficiency").alias("_made"))
        out = out.join(ceiling, "ware", "left").join(made, "ware", "left")
        over = F.coalesce(F.col("_made") > F.col("_most") + EPS, F.lit(False))
    else:
        over = F.lit(False)
    by = F.when(F.col("_named"), "extension").when(over, "efficiency")
    return out.groupBy("mod").agg(F.max(by).alias("by")).filter("by IS NOT NULL")  # extension goes before efficiency


def with_recipes(recipes: DataFrame, overrides: DataFrame) -> DataFrame:
    """recipes with all rows of a (ware, method) that overrides have replaced by these: inputs may be gone, too."""
    return recipes.join(overrides.select("ware", "method").distinct(), ["ware", "method"], "left_anti").unionByName(overrides.select(*[c for c in recipes.columns if c in overrides.columns]), allowMissingColumns=True)


def with_capacities(capacities: DataFrame, overrides: DataFrame, fields: Sequence[str]) -> DataFrame:
    """capacities (macro, ...) with the fields that overrides (macro, field, value, ord) set, the last of a field; macros and fields that aren't known are left out."""
    known = [f for f in fields if f in capacities.columns]
    own = overrides.groupBy(F.lower("macro").alias("_macro")).agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("ord"))).alias(f"_{f}") for f in known])
    out = capacities.join(own, F.lower("macro") == F.col("_macro"), "left")
    return out.withColumns({f: F.coalesce(F.col(f"_{f}").cast(capacities.schema[f].dataType), F.col(f)) for f in known}).select(*capacities.columns)
