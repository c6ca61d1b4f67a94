"""Hourly money of an empire by faction and by who sold or bought, tables of earnings, and the ships that can carry its goods."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import empty_to_null, hour_bin

# The ware of ships that a yard built, and hours that a mean takes.
BUILT, SMOOTH = "Ship construction", 12
NOBODY = "NIL"


def grouped(sales: DataFrame, buys: DataFrame, stations: DataFrame, services: Collection[str]) -> DataFrame:
    """(chart, group, t, money) of sales and buys (t, ware, money; faction, name and code of the partner or the own side).

    sales: seller_name, seller_code, buyer_faction; buys: buyer_name, buyer_code, and
    money below zero, which is turned round. The charts: `construction` of ships by
    faction, `faction` of other wares by faction, `seller`, and `buyer` of what is
    bought. services (with BUILT) are no wares. Objects other than stations (code)
    have their code after the name. Sales of nothing don't count.
    """
    known = stations.filter("code IS NOT NULL").select("code").distinct().withColumn("_station", F.lit(True))

    def party(df: DataFrame, side: str) -> DataFrame:
        name, code = F.coalesce(f"{side}_name", F.lit("?")), F.coalesce(f"{side}_code", F.lit("?"))
        return df.join(known.withColumnRenamed("code", f"{side}_code"), f"{side}_code", "left").withColumn("_party", F.when(F.col("_station"), name).otherwise(F.concat(name, F.lit(" ("), code, F.lit(")")))).drop("_station")

    built, ware = F.col("ware") == BUILT, ~F.coalesce(F.col("ware").isin(*services, BUILT), F.lit(False))
    row = lambda chart, group: F.struct(F.lit(chart).alias("chart"), group.alias("group"))
    of = F.array(F.when(built, row("construction", F.coalesce("buyer_faction", F.lit(NOBODY)))), F.when(ware & F.col("buyer_faction").isNotNull(), row("faction", F.col("buyer_faction"))), F.when(ware, row("seller", F.col("_party"))))
    sold = party(sales.filter("money > 0"), "seller").select("t", "money", F.explode(F.array_compact(of)).alias("c")).select("c.*", "t", "money")
    bought = party(buys.filter("money < 0"), "buyer").select(F.lit("buyer").alias("chart"), F.col("_party").alias("group"), "t", (-F.col("money")).alias("money"))
    return sold.unionByName(bought)


def series(rows: DataFrame, newest: float) -> DataFrame:
    """(chart, group, hour, money, running) of rows (chart, group, t, money): hours before `newest`, cut off toward zero; every group has each hour that its chart has.

    Rows are summed by hour before they move; a chart has as many hours as its history.
    """
    by = rows.groupBy("chart", "group", hour_bin(F.col("t"), F.lit(newest)).alias("hour")).agg(F.sum("money").alias("money"))
    hours = by.groupBy("chart").agg(F.collect_set("hour").alias("_hours"))
    grid = by.select("chart", "group").distinct().join(hours, "chart").select("chart", "group", F.explode("_hours").alias("hour"))
    out = grid.join(by, ["chart", "group", "hour"], "left").fillna(0, ["money"])
    return out.withColumn("running", F.sum("money").over(Window.partitionBy("chart", "group").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)))


def means(rows: DataFrame, newest: float) -> DataFrame:
    """(chart, hour, mean): the mean money of SMOOTH hours around each, half of a chart's hours where it has few; hours at the ends that lack neighbours are left out."""
    by = rows.groupBy("chart", hour_bin(F.col("t"), F.lit(newest)).alias("hour")).agg(F.sum("money").alias("money"))
    line = by.groupBy("chart").agg(F.array_sort(F.collect_list(F.struct("hour", "money"))).alias("all")).withColumn("n", F.size("all"))  # a row an hour
    line = line.withColumn("w", F.least(F.lit(SMOOTH), F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("int"))).withColumn("before", F.floor(F.col("w") / 2).cast("int"))
    at = line.select("chart", "all", "n", "w", "before", F.posexplode("all").alias("i", "x")).withColumn("first", F.col("i") - F.col("before") + 1)  # counted from one
    whole = at.filter((F.col("first") >= 1) & (F.col("first") + F.col("w") - 1 <= F.col("n")))
    total = F.aggregate(F.slice("all", F.col("first"), F.col("w")), F.lit(0.0), lambda a, x: a + x["money"].cast("double"))
    return whole.select("chart", F.col("x.hour").alias("hour"), (total / F.col("w")).alias("mean"))


def transfers(rows: DataFrame, now: float) -> DataFrame:
    """series() of transfers (t, station_name, station_code, money) between accounts, by the station's name or else its code."""
    return series(rows.select(F.lit("transfers").alias("chart"), F.coalesce("station_name", "station_code", F.lit("?")).alias("group"), "t", F.coalesce("money", F.lit(0.0)).alias("money")), now)


def earnings_variants(external: DataFrame, internal: DataFrame, keys: Sequence[str], hours: float) -> DataFrame:
    """(variant, keys, earnings, trades, items, per_trade, per_item, items_per_trade, per_hour, trades_per_hour) of trades (money, amount).

    variant `external`: sales to others alone; `all`: those within the empire too. Both
    come from one pass. Ratios are whole numbers, half to even, null over nothing.
    """
    flagged = external.select(*keys, "money", "amount", F.lit(False).alias("_own")).unionByName(internal.select(*keys, "money", "amount", F.lit(True).alias("_own")))
    sums = flagged.groupBy(*keys, "_own").agg(F.sum("money").alias("money"), F.count("*").alias("trades"), F.sum("amount").alias("items"))
    variants = F.when(F.col("_own"), F.array(F.lit("all"))).otherwise(F.array(F.lit("external"), F.lit("all")))
    out = sums.withColumn("variant", F.explode(variants)).groupBy("variant", *keys).agg(F.sum("money").alias("earnings"), F.sum("trades").alias("trades"), F.sum("items").alias("items"))
    by = lambda a, b: F.bround(F.try_divide(F.col(a).cast("double"), b))
    return out.withColumns({"per_trade": by("earnings", F.col("trades")), "per_item": by("earnings", F.col("items").cast("double")), "items_per_trade": by("items", F.col("trades")), "per_hour": by("earnings", F.lit(hours)), "trades_per_hour": F.bround(F.col("trades") / hours, 2)})


def presets(ships: DataFrame, mounts: DataFrame, models: DataFrame, engines: DataFrame) -> DataFrame:
    """(label, model, size, hold, speed, n) of trade ships (ship, name, code, macro): alike ones as one row.

    models (macro, model, size, hold, tags, drag) tell what carries containers, engines
    (macro, forward, travel_thrust) and mounts (ship, macro, n) how fast a ship travels:
    thrust by drag in whole numbers, half to even, null where either is unknown.
    Ships of no known model, and those without a hold for containers, are none.
    """
    thrust = mounts.join(engines.select("macro", (F.col("forward") * F.col("travel_thrust")).alias("_thrust")), "macro").groupBy("ship").agg(F.sum(F.coalesce("_thrust", F.lit(0.0)) * F.col("n")).alias("_thrust"))
    fit = models.filter("hold > 0").filter(F.coalesce(F.contains("tags", F.lit("container")), F.lit(False)))
    rows = ships.withColumn("macro", F.lower("macro")).join(fit.withColumnRenamed("macro", "_macro"), F.col("macro") == F.col("_macro")).join(thrust, "ship", "left")
    rows = rows.withColumn("speed", F.when((F.col("_thrust") > 0) & (F.col("drag") > 0), F.bround(F.col("_thrust") / F.col("drag")).cast("long")))
    code = F.when(empty_to_null("code").isNotNull(), F.concat(F.lit(" ("), "code", F.lit(")"))).otherwise("")
    label = F.concat(F.coalesce(empty_to_null("name"), "model"), code, F.lit(" — "), "model")
    same = rows.groupBy("model", "size", "hold", "speed").agg(F.count("*").alias("n"), F.min(label).alias("_label"))
    return same.select(F.when(F.col("n") > 1, F.concat("model", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("_label")).alias("label"), "model", "size", "hold", "speed", "n")
