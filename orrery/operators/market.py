"""What a market makes, uses, builds and trades, from rates, stock flows and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import settled

from .windows import fill, top


def capacity(modules: DataFrame, recipes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(station, faction, ware, made, used) an hour, of modules (station, faction, method, n, weight), recipes (method, ware, amount, seconds) and inputs (method, input, needed).

    A module that may make several wares has a weight below one for each.
    """
    runs = modules.join(recipes, "method").withColumn("runs", F.col("n") * F.col("weight") / F.col("seconds") * 3600)
    made = runs.select("station", "faction", "ware", (F.col("runs") * F.col("amount")).alias("made"), F.lit(0.0).alias("used"))
    used = runs.join(inputs, "method").select("station", "faction", F.col("input").alias("ware"), F.lit(0.0).alias("made"), (F.col("runs") * F.col("needed")).alias("used"))
    return made.union(used).groupBy("station", "faction", "ware").agg(F.sum("made").alias("made"), F.sum("used").alias("used"))


def actual_flows(flows: DataFrame, producers: DataFrame, consumers: DataFrame, yards: DataFrame, build: DataFrame, minable: DataFrame) -> DataFrame:
    """(ware, production, consumption) of flows (owner, ware, inflow, outflow).

    producers and consumers are pairs (owner, ware), yards (owner), build and
    minable (ware). What producers take in stock is production; of minables it is
    what consumers take in, and what others gain. What consumers give is
    consumption, but for build materials at yards.
    """
    f = flows.groupBy("ware", "owner").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    for side, on, mark in ((producers, ["owner", "ware"], "_p"), (consumers, ["owner", "ware"], "_c"), (yards, ["owner"], "_y"), (build, ["ware"], "_b"), (minable, ["ware"], "_m")):
        f = f.join(side.select(*on).distinct().withColumn(mark, F.lit(True)), on, "left")
    f = f.fillna(False, ["_p", "_c", "_y", "_b", "_m"])
    made = F.when(F.col("_m"), F.when(F.col("_c"), F.col("inflow")).otherwise(F.col("inflow") - F.col("outflow"))).when(F.col("_p"), F.col("inflow")).otherwise(0.0)
    used = F.when(F.col("_c") & ~(F.col("_y") & F.col("_b")), F.col("outflow")).otherwise(0.0)
    return f.groupBy("ware").agg(F.sum(made).alias("production"), F.sum(used).alias("consumption"))


def construction(flows: DataFrame, yards: DataFrame, producers: DataFrame, build: DataFrame, hours: float) -> DataFrame:
    """(ware, rate, basis): what is built of each build ware an hour, over max(hours, 1).

    basis `flow`: the greater of what producers give and yards take; `floor`, for
    wares that others than yards take as well: what yards take.
    """
    f = flows.join(build, "ware", "left_semi").groupBy("ware", "owner").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    f = f.join(yards.select("owner").distinct().withColumn("_y", F.lit(True)), "owner", "left").join(producers.select("owner", "ware").distinct().withColumn("_p", F.lit(True)), ["owner", "ware"], "left").fillna(False, ["_y", "_p"])
    sums = f.groupBy("ware").agg(F.sum(F.when(F.col("_y"), F.col("inflow")).otherwise(0.0)).alias("taken"), F.sum(F.when(F.col("_p"), F.col("outflow")).otherwise(0.0)).alias("given"), F.max(~F.col("_y") & ~F.col("_p") & (F.col("inflow") > 0)).alias("dual"))
    total = F.when(F.col("dual"), F.col("taken")).otherwise(F.greatest("taken", "given"))
    return sums.select("ware", (total / max(hours, 1.0)).alias("rate"), F.when(F.col("dual"), "floor").otherwise("flow").alias("basis"))


def summary(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """A row for each ware of offers (ware, side, price, amount, wanted) or rates (ware, production, consumption).

    cover: hours that what is offered for sale lasts at the consumption;
    understocked: less than a third of what is wanted is held; satisfy: hours to
    fill what is wanted from the surplus, or `never`, `backlog` (no more than a
    week away counts as neither), or nothing where nothing is wanted.
    """
    sell, buy = F.col("side") == "sell", F.col("side") == "buy"
    o = offers.groupBy("ware").agg(
        F.sum(F.when(sell, F.col("amount"))).alias("held"), F.sum(F.when(buy, F.col("amount"))).alias("wanted"), F.avg(F.when(sell, F.col("price"))).alias("ask"),
        F.avg(F.when(buy, F.col("price"))).alias("bid"), F.count(F.when(sell, 1)).alias("sellers"), F.count(F.when(buy, 1)).alias("buyers"),
    )
    s = o.join(rates, "ware", "full_outer").fillna(0.0, ["held", "wanted", "production", "consumption"]).fillna(0, ["sellers", "buyers"])
    balance = F.col("production") - F.col("consumption")
    hours = F.when(balance > 0, F.col("wanted") / balance)
    flag = F.when(F.col("wanted") == 0, "").when(balance <= 0, "never").when(hours > 168, "backlog").otherwise("sat")
    return s.select(
        "ware", "held", "wanted", "sellers", "buyers", "production", "consumption", balance.alias("balance"), F.when(F.col("consumption") > 0, F.col("held") / F.col("consumption")).alias("cover"), F.when(F.col("held") + F.col("wanted") > 0, F.col("held") / (F.col("held") + F.col("wanted")) * 100).alias("fill"),
        (F.col("held") * 3 < F.col("wanted")).alias("understocked"), F.when(F.col("ask") > 0, (F.col("bid") / F.col("ask") - 1) * 100).alias("premium"), hours.alias("satisfy_h"), flag.alias("satisfy"),
    )


def hourly(trades: DataFrame, width: float = 3600.0) -> DataFrame:
    """(ware, bin, volume, money) of trades (ware, t, amount, total) by bins of width seconds."""
    return trades.groupBy("ware", F.floor(F.col("t") / width).alias("bin")).agg(F.sum("amount").alias("volume"), F.sum("total").alias("money"))


def leaders(trades: DataFrame, n: int = 12) -> DataFrame:
    """(ware, seller, volume, place): the n sellers of most of each ware; the lesser one first where they sell as much."""
    v = trades.groupBy("ware", "seller").agg(F.sum("amount").alias("volume"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("ware").orderBy(F.desc("volume"), "seller"))).filter(F.col("place") <= n)


# The ware that workers stand for, that of shields and how much a module takes an hour, what stations can store,
# the share of what they want under which buyers are short, and rows of a split by sector.
WORKUNIT, CONDENSATE, SHIELD_RATE, STORED, SHORT, SECTORS = "workunit_busy", "condensate", 1.0, ("container", "solid", "liquid", "condensate"), 0.25, 12


def population(workforce: DataFrame, recipes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(station, faction, ware, used) an hour of workforce (station, faction, race, amount): what the work unit of a race takes, or else that of `default`.

    recipes: (method, amount, seconds) of the work unit, inputs: (method, input, needed).
    """
    own = recipes.select("method").distinct().withColumn("_own", F.lit(True))
    rows = workforce.filter("amount > 0").join(own, F.col("race") == F.col("method"), "left").withColumn("_m", F.when(F.col("_own"), F.col("race")).otherwise("default")).drop("method", "_own")
    rows = rows.withColumnsRenamed({"amount": "_workers", "_m": "method"}).join(recipes, "method").join(inputs, "method")
    used = F.col("needed") / F.col("amount") / F.col("seconds") * 3600 * F.col("_workers")
    return rows.groupBy("station", "faction", F.col("input").alias("ware")).agg(F.sum(used).alias("used"))


def shields(modules: DataFrame, macro: str) -> DataFrame:
    """(station, faction, ware, used) an hour of the shield modules (station, faction, macro), which have no recipe."""
    return modules.filter(F.col("macro") == macro).groupBy("station", "faction").agg((F.count("*") * SHIELD_RATE).alias("used")).select("station", "faction", F.lit(CONDENSATE).alias("ware"), "used")


def rates(capacity: DataFrame, *takers: DataFrame) -> DataFrame:
    """capacity() with what population() and shields() take."""
    every = capacity.select("station", "faction", "ware", "made", "used")
    for t in takers:
        every = every.unionByName(t.select("station", "faction", "ware", F.lit(0.0).alias("made"), "used"))
    return every.groupBy("station", "faction", "ware").agg(F.sum("made").alias("made"), F.sum("used").alias("used"))


def overview(wares: DataFrame, capacity: DataFrame, offers: DataFrame, cargo: DataFrame, traded: DataFrame, built: DataFrame, actual: DataFrame) -> DataFrame:
    """A row of 25 fields for each ware that stations store and that is made, used, traded or held.

    wares: (ware, name, price_avg, transport, volume, tags); capacity: (ware, made,
    used) an hour; offers: (station, ware, side, price, amount, site), site: of a
    building site; cargo: (station, ware, amount); traded: (ware, t, amount); built:
    (ware, rate, basis) of construction; actual: (ware, production, consumption) as
    stocks show. What can be mined has no capacity: what is delivered counts as made.

    under: buyers that hold less than a quarter of what they would have; fill: how
    much of that buyers have; satisfy_h: hours until all that is wanted is made
    beyond use, or, without a surplus, delivered at the rate of trade (`backlog`);
    `never` without trade either, `sat` where nothing is wanted. Numbers are rounded
    half to even.
    """
    total = capacity.groupBy("ware").agg(F.sum("made").alias("_made"), F.sum("used").alias("cons"))
    span = traded.agg(F.greatest((F.max("t") - F.min("t")) / 3600, F.lit(1.0)).alias("_span"))  # a row
    trade = traded.groupBy("ware").agg(F.sum("amount").alias("_traded"))
    held = cargo.groupBy("station", "ware").agg(F.sum("amount").alias("_held"))
    stock = held.groupBy("ware").agg(F.sum("_held").alias("_stock"))
    buys = offers.filter("side = 'buy'")
    asked = buys.groupBy("ware").agg(F.sum(F.when(~F.col("site"), F.col("amount"))).alias("_buy"), F.sum(F.when(F.col("site"), F.col("amount"))).alias("_build"), F.max("price").alias("_best"), F.sum(F.col("amount") * F.col("price")).alias("_worth"))
    wanted = buys.groupBy("station", "ware").agg(F.sum("amount").alias("_wanted")).join(held, ["station", "ware"], "left").fillna(0.0, ["_held"])
    buyers = wanted.groupBy("ware").agg(F.count("*").alias("buyers"), F.count(F.when(settled(F.col("_held") - SHORT / (1 - SHORT) * F.col("_wanted")) < 0, 1)).alias("under"), F.sum("_held").alias("_has"), F.sum(F.col("_held") + F.col("_wanted")).alias("_target"))
    rows = total.join(trade, "ware", "full").join(stock, "ware", "full").filter(F.col("ware").cast("string") != WORKUNIT)
    rows = rows.join(wares, "ware", "left").filter(F.coalesce("transport", F.lit("container")).isin(*STORED))
    rows = rows.join(asked, "ware", "left").join(buyers, "ware", "left").join(built.select("ware", F.col("rate").alias("_constr"), F.col("basis").alias("constr_flag")), "ware", "left").join(actual.select("ware", "production", "consumption"), "ware", "left").join(F.broadcast(span), F.lit(True))
    rows = rows.fillna(0.0, ["_made", "cons", "_traded", "_stock", "_buy", "_build", "_worth", "_has", "_target", "production", "consumption"]).fillna(0, ["buyers", "under"]).fillna("", ["constr_flag"])
    est = F.coalesce(F.contains("tags", F.lit("minable")), F.lit(False))
    rows = rows.withColumns({"est": est, "_all": F.col("cons") + F.coalesce("_constr", F.lit(0.0)), "_rate": F.col("_traded") / F.col("_span"), "_gap": F.col("_buy") + F.col("_build"), "_price": F.coalesce("price_avg", F.lit(0.0))})
    rows = rows.withColumn("_prod", F.when(F.col("est"), F.col("production")).otherwise(F.col("_made")))
    spare, priced = settled(F.col("_prod") - F.col("cons")), (F.col("_price") > 0) & (F.col("_best") > 0)
    flag = F.when(F.col("_gap") <= 0, "sat").when(spare > 0, "").when(F.col("_rate") > 0, "backlog").otherwise("never")
    hours = F.when(F.col("_gap") <= 0, 0.0).when(spare > 0, F.col("_gap") / spare).when(F.col("_rate") > 0, F.col("_gap") / F.col("_rate"))
    n = lambda c, d=0: F.bround(settled(c, 9), d)
    return rows.select(
        "ware", F.coalesce("name", F.col("ware").cast("string")).alias("name"), n(F.col("_prod")).alias("prod"), n(F.col("cons")).alias("cons"), n(F.col("_prod") - F.col("_all")).alias("balance"), n(F.col("_stock")).alias("stock"), n(F.when(F.col("_all") > 0, F.col("_stock") / F.col("_all")), 1).alias("cover"),
        n(F.col("_buy")).alias("buy"), n(F.col("_constr")).alias("constr_h"), "constr_flag", "buyers", "under", n(F.col("_build")).alias("build"), n(F.col("_rate")).alias("traded_h"), n(F.col("_rate") * F.col("_price")).alias("cr_h"), "est", n(F.when(F.col("_best") > 0, F.col("_best"))).alias("best_price"),
        n(F.when(priced, (F.col("_best") / F.col("_price") - 1) * 100), 1).alias("premium"), n(F.col("_worth")).alias("demand_cr"), n(F.when(F.col("_target") > 0, F.col("_has") / F.col("_target") * 100), 1).alias("fill"), n(hours, 1).alias("satisfy_h"), flag.alias("satisfy_flag"),
        F.coalesce("volume", F.lit(0.0)).cast("int").alias("vol"), n(F.col("production")).alias("prod_act"), n(F.col("consumption")).alias("cons_act"),
    )


def stock_trend(levels: DataFrame, gone: DataFrame, until: int = 0) -> DataFrame:
    """(ware, hour, stock): the sum of all owners' last known levels (owner, ware, hour, ord, level), from a ware's first hour to `until`.

    Before an owner's first level that counts, after its last one that; gone owners
    (owner) hold nothing from the hour after their last on, if that was before 0.
    """
    last = levels.groupBy("ware", "owner", "hour").agg(F.max_by("level", "ord").alias("level"))
    ends = last.groupBy("ware", "owner").agg(F.max("hour").alias("_last")).join(gone.select("owner").distinct(), "owner", "left_semi").filter("_last < 0")
    every = last.unionByName(ends.select("ware", "owner", (F.col("_last") + 1).alias("hour"), F.lit(0.0).alias("level")))
    begin = last.groupBy("ware").agg(F.min("hour").alias("_first"))
    grid = last.select("ware", "owner").distinct().join(begin, "ware").select("ware", "owner", F.explode(F.sequence("_first", F.lit(until).cast("long"))).alias("hour"))
    filled = fill(grid.join(every, ["ware", "owner", "hour"], "left"), ["ware", "owner"], ["hour"], "level", "_level")
    return filled.groupBy("ware", "hour").agg(F.sum("_level").alias("stock"))


def by_faction(capacity: DataFrame) -> DataFrame:
    """(ware, faction, made, used, place): who could make and use a ware, the greatest sum first."""
    rows = capacity.groupBy("ware", "faction").agg(F.sum("made").alias("made"), F.sum("used").alias("used"))
    return top(rows, ["ware"], [settled(F.col("made") + F.col("used")).desc(), F.col("faction")], 1 << 30, "place")


def unmet(offers: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """(ware, by, buy, build, place): what stations and building sites want, by sector or faction (a column of offers), the `most` greatest."""
    part = lambda site: F.sum(F.when(F.col("site") == site, F.col("amount")).otherwise(0.0))
    rows = offers.filter("side = 'buy'").groupBy("ware", by).agg(part(False).alias("buy"), part(True).alias("build"))
    return top(rows, ["ware"], [settled(F.col("buy") + F.col("build")).desc(), F.col(by)], most or 1 << 30, "place")


def books(offers: DataFrame) -> DataFrame:
    """(ware, side, place, station, price, amount): the offers of a ware in the order in which they are taken: buyers by falling, sellers by rising price."""
    turn = F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price"))
    return top(offers, ["ware", "side"], [turn, F.col("station"), F.col("amount")], 1 << 30, "place").select("ware", "side", "place", "station", "price", "amount")
