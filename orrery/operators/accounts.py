"""Profit and loss of stations, standings of factions, and status of entities and resource areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import clamp, signed_decibel, standing_band


def entries(trades: DataFrame, time: str = "t", total: str = "total") -> DataFrame:
    """(station, t, revenue, cost): a row for each side of each trade (seller, buyer)."""
    none = F.lit(0.0)
    sold = trades.select(F.col("seller").alias("station"), F.col(time).alias("t"), F.col(total).alias("revenue"), none.alias("cost"))
    return sold.unionByName(trades.select(F.col("buyer").alias("station"), F.col(time).alias("t"), none.alias("revenue"), F.col(total).alias("cost")))


def profit_and_loss(ledger: DataFrame, now: float, begin: float, trend_hours: float) -> DataFrame:
    """(station, trades, revenue, costs, net, net_h, recent_h) of entries(); hours count from `begin`, a tenth of one at least."""
    hours = max((now - begin) / 3600, 0.1)
    net = F.col("revenue") - F.col("cost")
    recent = F.sum(F.when(F.col("t") > now - 3600 * trend_hours, net).otherwise(0.0))
    out = ledger.groupBy("station").agg(F.count(F.lit(1)).alias("trades"), F.sum("revenue").alias("revenue"), F.sum("cost").alias("costs"), F.sum(net).alias("net"), (recent / trend_hours).alias("recent_h"))
    return out.withColumn("net_h", F.col("net") / hours)


def net_series(ledger: DataFrame, step: float = 86400.0) -> DataFrame:
    """(station, bin, net, running): net by time bin and its running sum. Bins are summed before the window."""
    by = ledger.groupBy("station", F.floor(F.col("t") / step).cast("long").alias("bin")).agg(F.sum(F.col("revenue") - F.col("cost")).alias("net"))
    return by.withColumn("running", F.sum("net").over(Window.partitionBy("station").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def station_values(modules: DataFrame, wares: DataFrame) -> DataFrame:
    """(station, value) of built modules (station, macro) at the mean price of their ware (component, price); macros without one count nothing. Of several wares of a component the dearest counts."""
    prices = wares.filter("component <> ''").groupBy(F.lower("component").alias("macro")).agg(F.max("price").alias("_price"))
    held = modules.groupBy("station", "macro").agg(F.count("*").alias("_n"))
    return held.join(prices, "macro", "left").groupBy("station").agg(F.sum(F.col("_n") * F.coalesce("_price", F.lit(0.0))).alias("value"))


def with_payback(result: DataFrame, values: DataFrame) -> DataFrame:
    """profit_and_loss() with value (station, value), zero where none is known, and payback: the hours in which the net pays it, null where it doesn't."""
    out = result.join(values, "station", "left").fillna(0.0, ["value"])
    return out.withColumn("payback", F.when((F.col("net_h") > 0) & (F.col("value") > 0), F.col("value") / F.col("net_h")))


def cumulative(ledger: DataFrame, now: float, step: float = 86400.0) -> DataFrame:
    """(station, t, hours, total): the running net of entries() at each of a station's times, with the hours to `now`, which are negative.

    What happens at a time counts at once. Times are summed first, then bins of
    `step` seconds are run through, then the times of each bin from what went before
    it, so that a busy station's history is spread over tasks by bins.
    """
    rows = ledger.groupBy("station", "t").agg(F.sum(F.col("revenue") - F.col("cost")).alias("net")).withColumn("bin", F.floor(F.col("t") / step))
    bins = rows.groupBy("station", "bin").agg(F.sum("net").alias("_net"))
    before = bins.withColumn("_before", F.coalesce(F.sum("_net").over(Window.partitionBy("station").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_net")
    own = F.sum("net").over(Window.partitionBy("station", "bin").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(before, ["station", "bin"]).select("station", "t", ((F.col("t") - now) / 3600).alias("hours"), (F.col("_before") + F.col("_own")).alias("total"))


def mineable(areas: DataFrame, now: float) -> DataFrame:
    """areas (sector, ware, left, capacity, respawn, start, speed; respawn in minutes, start in seconds) with status, mineable, rate and eta.

    mineable: what is left of a live area, all of a full one, else nothing; rate: what
    would grow back in an hour if it were always empty; eta: minutes until an area is
    full again, null unless it waits for that.
    """
    full, none = F.coalesce(F.col("capacity").cast("double"), F.lit(0.0)), F.lit(0.0)
    out = areas.withColumn("status", area_status(F.col("left"), F.col("capacity"), F.col("respawn"), F.col("start"), F.lit(now)))
    return out.withColumns({
        "mineable": F.when(F.col("status") == "live", F.col("left").cast("double")).when(F.col("status") == "full", full).otherwise(none),
        "rate": F.when(F.col("respawn") > 0, full / F.col("respawn") * 60).otherwise(none),
        "eta": F.when(F.col("status") == "respawning", F.bround((F.col("start") - now) / 60).cast("long")),
    })


def sector_resources(areas: DataFrame, wares: list[str]) -> DataFrame:
    """(sector, a column a ware, a column rep.ware a ware): what can be mined now and what grows back in an hour, of mineable(); zero where there is none."""
    at = lambda value, ware: F.sum(F.when(F.col("ware") == ware, F.col(value)).otherwise(0.0))
    return areas.groupBy("sector").agg(*[at("mineable", w).alias(str(w)) for w in wares], *[at("rate", w).alias(f"rep.{w}") for w in wares])


def area_lists(areas: DataFrame) -> DataFrame:
    """(sector, areas): a map of each ware to its areas of mineable() as (status, capacity, now, speed, eta), those that hold most first. A list has as many rows as the sector has areas of the ware."""
    whole = lambda x: F.bround(F.coalesce(x.cast("double"), F.lit(0.0))).cast("long")
    row = F.struct((-whole(F.col("mineable"))).alias("_now"), (-whole(F.col("capacity"))).alias("_capacity"), "status", F.coalesce("speed", F.lit("")).alias("speed"), "eta")
    by = areas.groupBy("sector", "ware").agg(F.array_sort(F.collect_list(row)).alias("a"))
    own = F.transform("a", lambda x: F.struct(x["status"].alias("status"), (-x["_capacity"]).alias("capacity"), (-x["_now"]).alias("now"), x["speed"].alias("speed"), x["eta"].alias("eta")))
    return by.groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct("ware", own.alias("a")))).alias("areas"))


def relation_matrix(relations: DataFrame, roster: list[str]) -> DataFrame:
    """(faction, a column a faction) of relations (faction, other, effective) of the factions in the roster.

    A row for each faction, directed from it: zero where nothing is known, null toward
    itself. Of several rows of a pair the greatest counts.
    """
    known = relations.filter(F.col("faction").isin(*roster))
    cells = [F.max(F.when(F.col("other") == o, F.col("effective"))).alias(o) for o in roster]
    rows = relations.sparkSession.createDataFrame([(f,) for f in roster], "faction string").join(known.groupBy("faction").agg(*cells), "faction", "left")
    return rows.select("faction", *[F.when(F.col("faction") != o, F.round(F.coalesce(F.col(f"`{o}`"), F.lit(0.0)), 4)).alias(o) for o in roster])


def standings(roster: list[str], relations: DataFrame, discounts: DataFrame, licences: DataFrame, player: str = "player") -> DataFrame:
    """(faction, base, booster, effective, rank_value, band, discount, licences) of each other faction with the player.

    relations (faction, other, base, booster, effective) are the player's own; discounts
    (faction, other, discount) those that a faction grants the player; licences (faction,
    factions) list the factions by spaces that a licence of the player holds for.
    """
    best = relations.filter(F.col("faction") == player).groupBy(F.col("other").alias("faction")).agg(F.max("base").alias("base"), F.max("booster").alias("booster"), F.max("effective").alias("effective"))
    off = discounts.filter(F.col("other") == player).groupBy("faction").agg(F.max("discount").alias("discount"))
    held = licences.filter(F.col("faction") == player).select(F.explode(F.split(F.trim(F.coalesce("factions", F.lit(""))), r"\s+")).alias("faction")).groupBy("faction").agg(F.count("*").alias("licences"))
    rows = relations.sparkSession.createDataFrame([(f,) for f in roster if f != player], "faction string")
    for right in (best, off, held):
        rows = rows.join(right, "faction", "left")
    rows = rows.fillna(0.0, ["base", "booster", "effective", "discount"]).fillna(0, ["licences"]).withColumn("effective", clamp(F.col("effective"), -1.0, 1.0))
    return rows.select("faction", "base", "booster", "effective", signed_decibel(F.col("effective")).alias("rank_value"), standing_band(F.col("effective")).alias("band"), "discount", "licences")


def area_status(left: Column, capacity: Column, respawn: Column, start: Column, now: Column) -> Column:
    """live, unknown, never, full or respawning, the first that holds; an unknown start is respawning."""
    return F.when(left > 0, "live").when(F.coalesce(capacity, F.lit(0)) == 0, "unknown").when(respawn < 0, "never").when(start <= now, "full").otherwise("respawning")


def redirected(df: DataFrame, commanders: DataFrame, role: str) -> DataFrame:
    """df with `role` set to its commander, where commanders (ship, cmdr) names one, `role`_executor (the ship itself) and `role`_proxied."""
    c = commanders.select(F.col("ship").alias("_ship"), F.col("cmdr").alias("_cmdr"))
    led = F.col("_cmdr").isNotNull()
    out = df.join(c, F.col(role) == F.col("_ship"), "left").withColumns({f"{role}_executor": F.when(led, F.col(role)), f"{role}_proxied": led, role: F.when(led, F.col("_cmdr")).otherwise(F.col(role))})
    return out.drop("_ship", "_cmdr")
