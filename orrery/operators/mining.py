"""Raw supply of stations: what the miners of a class bring for each of its wares, and what a station lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import settled

from .storage import blocked

#: The order of ships' sizes.
SIZES = ("S", "M", "L", "XL")


def class_totals(wares: DataFrame) -> DataFrame:
    """(station, class, class_used, class_observed, n): volumes an hour of wares (station, ware, class, volume, used, observed); an unknown volume is one, an unknown rate zero."""
    size = F.coalesce("volume", F.lit(1.0))
    return wares.groupBy("station", "class").agg(F.sum(F.coalesce("used", F.lit(0.0)) * size).alias("class_used"), F.sum(F.coalesce("observed", F.lit(0.0)) * size).alias("class_observed"), F.count("*").alias("n"))


def split(wares: DataFrame, pools: DataFrame) -> DataFrame:
    """wares (station, ware, class, volume, used, observed and more) with class_used, class_observed, balance, share and theoretical.

    The pools (station, class, hold, rate; hold that of all its ships) of a class
    carry for all its wares: share is a ware's part of the volume that the station
    uses of the class, an equal part where it uses none; theoretical are the units
    an hour that the share of all pools' hauls makes, zero without pools.
    """
    supply = pools.groupBy("station", "class").agg(F.sum(F.col("hold") * F.col("rate")).alias("_supply"))
    size = F.coalesce("volume", F.lit(1.0))
    out = wares.join(class_totals(wares), ["station", "class"]).join(supply, ["station", "class"], "left")
    used, seen = F.coalesce("used", F.lit(0.0)), F.coalesce("observed", F.lit(0.0))
    share = F.when(F.col("class_used") > 0, used * size / F.col("class_used")).otherwise(1.0 / F.col("n"))
    out = out.withColumns({"used": used, "observed": seen, "balance": seen - used, "share": share})
    return out.withColumn("theoretical", F.coalesce("_supply", F.lit(0.0)) * F.col("share") / size).drop("_supply", "n")


def cards(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """(station, class, used, observed, percent, state, options, least, hauls, blocked, station_need) of rows of split() with stock and limit.

    state: `full` where all wares that are used and fall short have no room left,
    so that miners wouldn't help; `short`, or `covered`. pools (station, class, size,
    miners, hold, rate, more; hold that of one ship): options are the sizes of which
    some more miners would close a shortfall, least the fewest, hauls what one more
    ship of each size adds. station_need is the sum of least over a station's classes.
    Lists hold a row a size, or a ware of the class.
    """
    takes = F.col("used") > 0
    none = takes & blocked(F.col("stock"), F.col("limit"))
    by = rows.groupBy("station", "class").agg(
        F.max("class_used").alias("used"), F.max("class_observed").alias("observed"), F.count(F.when(takes, 1)).alias("_takes"), F.count(F.when(none, 1)).alias("_none"),
        F.array_sort(F.collect_set(F.when(none, F.col("ware").cast("string")))).alias("blocked"),
    )
    lacks = (F.col("used") > 0) & (settled(F.col("observed") - F.col("used")) < 0)
    by = by.withColumn("state", F.when(lacks & (F.col("_takes") > 0) & (F.col("_none") == F.col("_takes")), "full").when(lacks, "short").otherwise("covered"))
    place = F.array_position(F.array(*map(F.lit, SIZES)), F.col("size"))
    own = pools.groupBy("station", "class").agg(F.array_sort(F.collect_list(F.struct(F.when(place > 0, place).otherwise(len(SIZES) + 1).alias("place"), "size", "miners", "more", (F.col("hold") * F.col("rate")).alias("haul")))).alias("_pools"))
    out = by.join(own, ["station", "class"], "left").withColumn("_pools", F.coalesce("_pools", F.array()))
    wanted = F.filter("_pools", lambda p: (F.col("state") == "short") & (p["more"] > 0))
    out = out.withColumn("_wanted", wanted).withColumns({
        "percent": F.when(F.col("used") > 0, F.col("observed") * 100 / F.col("used")),
        "options": F.transform("_wanted", lambda p: F.concat(F.lit("+"), p["more"].cast("long").cast("string"), F.lit(" "), p["size"])),
        "least": F.array_min(F.transform("_wanted", lambda p: p["more"].cast("long"))),
        "hauls": F.transform(F.filter("_pools", lambda p: (p["miners"] > 0) | ((F.col("state") == "short") & (p["more"] > 0))), lambda p: F.concat_ws(" ", p["size"], p["miners"].cast("string"), F.round(p["haul"]).cast("long").cast("string"))),
    })
    need = out.groupBy("station").agg(F.coalesce(F.sum("least"), F.lit(0)).alias("station_need"))
    return out.join(need, "station").select("station", "class", "used", "observed", "percent", "state", "options", "least", "hauls", "blocked", "station_need")
