"""The price book: which rule an offer's price follows, what the rule says, and how far the offer is from that.

An offer is a row of station, ware, side, price, amount, flags, host (its class),
owner, low, mean, high, allocation, net, stock, inbound, and the flags manual,
locked, yard, ration, consumed and has_sell of whether its (station, ware) or
station is in such a set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import pricing as P

from .aggregates import binned_rms, equal_count_rms
from .quantiles import exact

c = F.col
BAND = ("low", "mean", "high")


def preferred(makes: DataFrame, inputs: DataFrame, by: list[str]) -> DataFrame:
    """makes (*by, ware, method) with each input (ware, method, input): those of its method, else of the default one, else of any."""
    both = makes.withColumnRenamed("method", "_own").join(inputs, "ware")
    rank = F.when(c("method").eqNullSafe(c("_own")), 0).when(c("method") == "default", 1).otherwise(2)
    both = both.withColumn("_rank", rank).withColumn("_least", F.min("_rank").over(Window.partitionBy(*by, "ware", "_own")))
    return both.filter("_rank = _least").select(*by, "input").distinct()


def ration_pairs(workforce: DataFrame, meals: DataFrame) -> DataFrame:
    """(station, ware) that a station's workers (station, race, amount) eat: meals (race, ware), those of `default` for a race without any."""
    present = workforce.filter("amount > 0").select("station", "race").distinct()
    known = meals.select("race").distinct().withColumn("_known", F.lit(True))
    diet = present.join(known, "race", "left").withColumn("race", F.when(c("_known"), c("race")).otherwise("default"))
    return diet.join(meals, "race").select("station", "ware").distinct()


def consumed_pairs(built: DataFrame, makes: DataFrame, inputs: DataFrame, build_wares: Sequence, rations: DataFrame) -> DataFrame:
    """(station, ware) that a station uses up itself: inputs of what its built modules (station, macro) make, a list of build wares at yards, and rations."""
    fed = built.select("station", "macro").distinct().join(preferred(makes, inputs, ["macro"]), "macro").select("station", c("input").alias("ware"))
    yards = built.filter(c("macro").startswith("buildmodule")).select("station").distinct()
    return fed.union(yards.select("station", F.explode(F.array(*map(F.lit, build_wares))))).union(rations.select("station", "ware")).distinct()


def classified(offers: DataFrame) -> DataFrame:
    """offers with their book and population: a price set by hand goes before the offer's flags, these before its station's whitelist and kind."""
    flag = lambda name: F.contains(F.coalesce("flags", F.lit("")), F.lit(name))
    book = F.when((F.coalesce("owner", F.lit("")) == "player") | c("manual"), "player").when(flag("supplies"), "supplies").when(flag("shady"), "shady").when(c("locked"), "lockavgprice").when(F.coalesce("host", F.lit("")) == "buildstorage", "buildstorage").when(c("yard"), "yard").otherwise("main")
    population = F.when(~c("book").isin("main", "yard"), c("book")).when(c("has_sell"), "supplier").when(c("ration"), "ration").otherwise("input")
    return offers.withColumn("book", book).withColumn("population", population)


def input_offsets(book: DataFrame, least: int = 2) -> DataFrame:
    """(station, offset): the median shift that a station's own bids for inputs imply, of `least` or more that lie inside their band."""
    seen = P.position_of(c("price"), *map(c, BAND))
    bids = book.filter("book IN ('main', 'yard') AND population = 'input' AND side = 'buy' AND allocation <> 0").withColumn("_s", seen).filter(F.abs("_s") < 1)
    implied = P.fill(c("_s")) - F.coalesce("net", F.lit(0.0)) / c("allocation")
    return bids.groupBy("station").agg(F.median(implied).alias("offset"), F.count("*").alias("_n")).filter(c("_n") >= least).drop("_n")


def predicted(book: DataFrame, fitted: bool = False, power: bool = False) -> DataFrame:
    """book with price_pred, tier, s_obs and res, the distance in half bands.

    Yards take their station's own offset where one is known, all inputs if
    `fitted`. A supplier above its capped target of a ware that it uses up itself
    is priced as a consumer. `power` prices yards by the power form.
    """
    low, mean, high = map(c, BAND)
    net, stock = F.coalesce("net", F.lit(0.0)), F.coalesce("stock", F.lit(0.0)) + F.coalesce("inbound", F.lit(0.0))
    out = book.join(input_offsets(book), "station", "left")
    usual = F.when(c("book") == "yard", P.SHIFT["yard"]).otherwise(P.SHIFT["input"])
    consumer = F.when((c("book") == "yard") | F.lit(fitted), F.coalesce("offset", usual)).otherwise(usual)
    capped = P.capped_target(c("allocation"), mean)
    exempt = c("consumed") & (net > capped)
    supplier = c("population") == "supplier"
    target = F.when(supplier & ~F.coalesce(exempt, F.lit(False)), capped).otherwise(c("allocation"))
    shift = F.when(supplier, F.when(exempt, consumer).otherwise(P.SHIFT["supplier"])).when(c("population") == "ration", P.SHIFT["ration"]).otherwise(consumer)
    room = F.nullif(stock + F.coalesce("amount", F.lit(0.0)), F.lit(0.0))
    law = P.main_price(net, target, low, mean, high, shift)
    if power:
        law = F.when(c("book") == "yard", P.band_price(P.yard_band(net / room), low, high)).otherwise(law)
    tier = F.when(c("book") == "shady", P.shady_tier(c("price"), mean, high))
    rule = F.when(c("book").isin("main", "yard"), law).when(c("book") == "lockavgprice", P.locked_price(mean, c("side"))).when(c("book") == "supplies", P.price(F.lit(P.SUPPLIES), low, mean, high)).when(c("book") == "shady", P.shady_price(tier, mean, high)).when((c("book") == "buildstorage") & (room > 0), P.band_price(P.build_band(stock / room), low, high))
    half = F.when(c("price") >= mean, high - mean).otherwise(mean - low)
    half = F.when(half > 0, half)
    return out.withColumns({"price_pred": rule, "tier": tier, "s_obs": (c("price") - mean) / half, "res": (c("price") - rule) / half}).drop("offset")


def scores(book: DataFrame) -> DataFrame:
    """(population, n, median_res, rmse) of the offers of each population that have a residual."""
    own = book.filter("res IS NOT NULL").withColumn("_abs", F.abs("res"))
    return own.groupBy("population").agg(F.count("*").alias("n"), F.sqrt(F.avg(c("res") * c("res"))).alias("rmse")).join(exact(own, ["population"], "_abs", {"median_res": 0.5}), "population")


#: Bins of the fill and its greatest, and the residual from which an offer is far off.
YARD_BINS, FILL_MOST, FAR = 16, 1.2, 0.25


def yard_forms(book: DataFrame) -> DataFrame:
    """(form, n, bin_rmse, bin_rmse_equal, mad, tail) of bids of yards under the three rules that might price them.

    `power`: the power form of the fill of what the yard has, awaits and asks for;
    `flat` and `fitted`: the curve on the allocation, with the yards' offset or the
    station's own where one is known; rations and supplies have their own offsets.
    Each is held against the whole population in bins of the same fill, all bins
    alike, by medians of the distance in half bands; mad is the median over all,
    tail the part that is far off. Offers without a band or a prediction don't count.
    Needs a checkpoint folder.
    """
    low, mean, high = map(c, BAND)
    rows = book.filter("book = 'yard' AND side = 'buy'").join(input_offsets(book), "station", "left")
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    net, room = zero("net"), zero("stock") + zero("inbound") + zero("amount")
    fill = F.when(room > 0, net / room)
    half = F.when(c("price") >= mean, high - mean).otherwise(mean - low)

    def curve(shift):
        own = F.when(c("population") == "supplier", P.SHIFT["supplier"]).when(c("population") == "ration", P.SHIFT["ration"]).otherwise(shift)
        return P.main_price(net, c("allocation"), low, mean, high, own)

    yard = F.lit(P.SHIFT["yard"])
    laws = {"power": F.when(fill.isNotNull(), P.band_price(P.yard_band(fill), low, high)), "flat": curve(yard), "fitted": curve(F.coalesce("offset", yard))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), law.alias("pred")) for k, law in laws.items()]))
    rows = rows.filter(half > 0).select("price", fill.alias("fill"), half.alias("half"), each.alias("f")).select("fill", "f.form", F.abs((c("price") - c("f.pred")) / c("half")).alias("res")).filter("res IS NOT NULL").checkpoint()  # read by each of the quantiles
    sums = rows.groupBy("form").agg(F.count("*").alias("n"), F.avg((c("res") > FAR).cast("double")).alias("tail")).join(exact(rows, ["form"], "res", {"mad": 0.5}), "form")
    for name, found in (("bin_rmse", binned_rms(rows, "fill", "res", 0.0, FILL_MOST, YARD_BINS, ["form"])), ("bin_rmse_equal", equal_count_rms(rows, "fill", "res", YARD_BINS, ["form"]))):
        sums = sums.join(found.select("form", c("rms").alias(name)), "form", "left")
    return sums.select("form", "n", "bin_rmse", "bin_rmse_equal", "mad", "tail")


def shady_census(book: DataFrame, workforce: DataFrame) -> DataFrame:
    """(tier, stations, offers, idle) of shady offers of predicted(): idle is the part of a tier's stations without workers (station, amount)."""
    per = book.filter("book = 'shady'").groupBy("station", "tier").agg(F.count("*").alias("offers"))
    hands = workforce.groupBy("station").agg(F.sum("amount").alias("_hands"))
    rows = per.join(hands, "station", "left")
    return rows.groupBy("tier").agg(F.count("*").alias("stations"), F.sum("offers").alias("offers"), F.avg((F.coalesce("_hands", F.lit(0)) == 0).cast("double")).alias("idle"))
