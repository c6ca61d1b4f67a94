"""Trade lanes: the cheapest offers of a ware with the best paid, where they can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import half_up, settled

from .graph import hops, routes
from .windows import top

# Offers of each side that are looked at for a ware, and lanes that are kept.
OFFERS, LANES = 15, 25


def sellers(offers: DataFrame, stock: DataFrame) -> DataFrame:
    """Sell offers (ware, station, sector, price, amount, player, site) that count, with ask and reserve.

    The player's own stations sell at no price, and may give all their stock
    (station, ware, amount); others need a price. Building sites sell nothing.
    """
    held = stock.groupBy("station", "ware").agg(F.sum("amount").alias("_stock"))
    own = offers.filter("NOT site AND (price > 0 OR player)").join(held, ["station", "ware"], "left")
    reserve = F.when(F.col("player"), F.greatest("amount", F.coalesce("_stock", F.lit(0.0)))).otherwise(F.col("amount"))
    own = own.withColumns({"ask": F.when(F.col("player"), 0.0).otherwise(F.col("price")), "reserve": reserve})
    return own.filter("amount > 0 OR reserve > 0").drop("_stock")


def buyers(offers: DataFrame) -> DataFrame:
    """Buy offers that ask for something at a price, with bid: the player's own stations pay nothing."""
    return offers.filter("price > 0 AND amount > 0").withColumn("bid", F.when(F.col("player"), 0.0).otherwise(F.col("price")))


def lanes(sells: DataFrame, buys: DataFrame, edges: DataFrame, wares: DataFrame, most: int = 64) -> DataFrame:
    """(ware, seller, buyer, ask, bid, spread, jumps, per_m3, rate, units, reserve_units, total, reserve_only, place) of sellers() and buyers().

    Of the OFFERS lowest asks and highest bids of a ware (the lesser station first
    where they are equal) the pairs with a spread whose sectors are joined over
    edges (a, b). rate: the spread by volume (wares: ware, volume) and jump, one at
    least; units: what both sides can do. The LANES best of a ware stay. Wares
    without a volume have none. Needs a checkpoint folder.
    """
    sold = top(sells, ["ware"], [F.col("ask"), F.col("station")], OFFERS, "_n").select("ware", F.col("station").alias("seller"), F.col("sector").alias("_from"), "ask", F.col("amount").alias("_sold"), F.col("reserve").alias("_all"))
    asked = top(buys, ["ware"], [F.col("bid").desc(), F.col("station")], OFFERS, "_n").select("ware", F.col("station").alias("buyer"), F.col("sector").alias("_to"), "bid", F.col("amount").alias("_asked"))
    pairs = sold.join(asked, "ware").withColumn("spread", settled(F.col("bid") - F.col("ask"))).filter("spread > 0").join(wares.filter("volume > 0").select("ware", "volume"), "ware").checkpoint()
    reached = hops(edges, pairs.select(F.col("_from").alias("source")).distinct(), most).select(F.col("source").alias("_from"), F.col("node").alias("_to"), F.col("hops").alias("jumps"))
    rows = pairs.join(reached, ["_from", "_to"]).withColumns({"units": F.least("_sold", "_asked"), "reserve_units": F.least("_all", "_asked")}).filter("units > 0 OR reserve_units > 0")
    rows = rows.withColumns({"per_m3": F.col("spread") / F.col("volume"), "rate": half_up(F.col("spread") / F.col("volume") / F.greatest("jumps", F.lit(1)), 2), "total": F.col("units") * F.col("spread"), "reserve_only": F.col("units") <= 0})
    best = top(rows, ["ware"], [F.col("rate").desc(), F.col("seller"), F.col("buyer")], LANES, "place")
    return best.select("ware", "seller", "buyer", "ask", "bid", "spread", "jumps", "per_m3", "rate", "units", "reserve_units", "total", "reserve_only", "place")


def measured(found: DataFrame, stations: DataFrame, gates: DataFrame, sectors: DataFrame) -> DataFrame:
    """lanes() with plain_km and highway_km of the shortest way and those of the fastest for ships that use highways (quick_plain_km, quick_highway_km); null without gates between."""
    wanted = found.select(F.col("seller").alias("source"), F.col("buyer").alias("target")).distinct()
    out = found
    for highways, names in ((False, ("plain_km", "highway_km")), (True, ("quick_plain_km", "quick_highway_km"))):
        way = routes(stations, gates, sectors, wanted, highways).select(F.col("source").alias("seller"), F.col("target").alias("buyer"), *[F.col(c).alias(n) for c, n in zip(("plain_km", "highway_km"), names)])
        out = out.join(way, ["seller", "buyer"], "left")
    return out
