"""What is wrong in an empire: inputs that run out, stores that fill up, idle ships, missing workers and crew, raw wares that are short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import settled

from .quantiles import exact

# Hours of cover that are too few, per cent that are too full, standing orders of idle ships, poor skill, share of workers that is enough,
# hours of the window of deliveries and its least, trips an hour by size where none were seen.
LOW_HOURS, FULL_PERCENT, SKILL_LOW, STAFFED = 3.0, 80.0, 3, 0.9
IDLE = ("Wait", "HoldPosition", "DockAndWait", "DockAt")
WINDOW, LEAST_WINDOW = 6.0, 0.5
TRIPS = {"S": 3.0, "M": 2.0, "L": 1.0, "XL": 0.8}


def starving(rates: DataFrame, stock: DataFrame) -> DataFrame:
    """(station, ware, used, stock, cover, status) of inputs (station, ware, used an hour) that last less than three hours."""
    rows = rates.filter("used > 0").join(stock.groupBy("station", "ware").agg(F.sum("amount").alias("stock")), ["station", "ware"], "left").withColumn("stock", F.coalesce(F.col("stock").cast("double"), F.lit(0.0)))
    rows = rows.withColumn("cover", F.col("stock") / F.col("used")).filter(settled(F.col("cover")) < LOW_HOURS)
    return rows.select("station", "ware", "used", "stock", "cover", F.when(F.col("stock") <= 0, "stalled").otherwise("low").alias("status"))


def saturated(stores: DataFrame, cargo: DataFrame, wares: DataFrame, net: DataFrame) -> DataFrame:
    """(station, tags, capacity, used, percent, hours) of stores (station, tags, capacity) over four fifths full.

    A store of several tags (in a text, by spaces) takes the wares (ware, transport,
    volume) of each. hours: until net production (station, ware, rate) fills it; 0 if it is full, null if it doesn't fill.
    """
    room = stores.groupBy("station", "tags").agg(F.sum("capacity").alias("capacity")).filter("capacity > 0")
    by_tag = lambda df, amount, name: df.join(wares, "ware").groupBy("station", "transport").agg(F.sum(F.col(amount) * F.coalesce("volume", F.lit(1.0))).alias(name))
    kinds = room.select("station", "tags", F.explode(F.array_distinct(F.split(F.trim("tags"), r"\s+"))).alias("transport"))
    held = kinds.join(by_tag(cargo, "amount", "_held"), ["station", "transport"], "left").join(by_tag(net, "rate", "_net"), ["station", "transport"], "left")
    sums = held.groupBy("station", "tags").agg(F.coalesce(F.sum("_held"), F.lit(0.0)).alias("used"), F.coalesce(F.sum("_net"), F.lit(0.0)).alias("_net"))
    out = room.join(sums, ["station", "tags"]).withColumn("percent", F.col("used") * 100 / F.col("capacity")).filter(settled(F.col("percent")) > FULL_PERCENT)
    hours = F.when(settled(F.col("used") - F.col("capacity")) >= 0, 0.0).when(settled(F.col("_net")) > 0, (F.col("capacity") - F.col("used")) / F.col("_net"))
    return out.select("station", "tags", "capacity", "used", "percent", hours.alias("hours"))


def idle(ships: DataFrame, orders: DataFrame, followers: DataFrame) -> DataFrame:
    """(ship, size, standing) of ships (ship, size) that nobody leads and that have no order (ship, ord, name, standing, state) but an idle or stopped standing one."""
    told = orders.groupBy("ship").agg(F.max(~F.col("standing")).alias("_busy"), F.min_by(F.struct("name", "state"), F.when(F.col("standing"), F.col("ord"))).alias("_own"))
    free = ships.filter("size <> 'XS'").join(followers.select(F.col("follower").alias("ship")).distinct(), "ship", "left_anti").join(told, "ship", "left").filter("_busy IS NULL OR NOT _busy")
    known, runs = F.col("_own.name").isin(*IDLE), F.coalesce(F.col("_own.state") == "started", F.lit(False))
    free = free.filter(F.col("_own").isNull() | known | ~runs)
    return free.select("ship", "size", F.when(F.col("_own").isNull(), "none").when(known, F.col("_own.name")).otherwise(F.concat("_own.name", F.lit(" (not running)"))).alias("standing"))


def understaffed(modules: DataFrame, parts: DataFrame, workforce: DataFrame) -> DataFrame:
    """(station, have, wanted, housing, percent, crowded) of stations with less than nine tenths of the workers that their modules (station, macro) of parts (macro, housing, workers) want."""
    need = modules.join(parts, "macro", "left").groupBy("station").agg(F.sum("housing").alias("housing"), F.sum("workers").alias("wanted")).filter("wanted > 0")
    out = need.join(workforce.groupBy("station").agg(F.sum("amount").alias("have")), "station", "left").fillna(0, ["have", "housing"]).filter(settled(F.col("have") - STAFFED * F.col("wanted")) < 0)
    return out.select("station", "have", "wanted", "housing", (F.col("have") * 100 / F.col("wanted")).alias("percent"), (F.col("housing") < F.col("wanted")).alias("crowded"))


def crew_gaps(ships: DataFrame) -> DataFrame:
    """(ship, size, missing, issues, minor) of ships (ship, size, pilot, engineer, skill, crew, crew_most) that lack someone; minor: a small one that lacks crew alone."""
    big, lacking = F.col("size").isin("L", "XL"), F.col("pilot").isNull()
    issues = F.array_compact(F.array(
        F.when(lacking, "no captain"),
        F.when(F.col("engineer").isNull() & (big | (F.col("size") == "M")), "no engineer"),
        F.when(~lacking & big & (F.col("skill") < SKILL_LOW), F.concat(F.lit("pilot skill "), F.round("skill").cast("int"))),
    ))
    missing = F.greatest(F.lit(0), F.coalesce((F.col("crew_most") - F.coalesce("crew", F.lit(0))).cast("int"), F.lit(0)))
    out = ships.filter("size <> 'XS'").select("ship", "size", missing.alias("missing"), F.concat_ws(", ", issues).alias("issues"))
    return out.filter("issues <> '' OR missing > 0").withColumn("minor", (F.col("size") == "S") & (F.col("issues") == ""))


def typical_hold(models: DataFrame, own: DataFrame) -> DataFrame:
    """(class, size, hold): the median hold of the models (macro, class, size, hold) that are owned (macro), or of all where none is."""
    rows = models.filter("hold > 0").join(own.select("macro").distinct().withColumn("_own", F.lit(True)), "macro", "left")
    every, mine = (exact(x, ["class", "size"], "hold", {n: 0.5}) for x, n in ((rows, "_hold"), (rows.filter("_own"), "_mine")))
    return every.join(mine, ["class", "size"], "left").select("class", "size", F.coalesce("_mine", "_hold").alias("hold"))


def inflow(deliveries: DataFrame, own: DataFrame, now: float) -> DataFrame:
    """(station, ware, window_h, observed, own, n) an hour of deliveries (station, ware, t, amount, miner); own and n are of a station's own miners (station, miner).

    The window ends now and is six hours, or the time since the first delivery, but at least half an hour.
    """
    window = deliveries.groupBy("station", "ware").agg(F.greatest(F.lit(LEAST_WINDOW), F.least(F.lit(WINDOW), (F.lit(now) - F.min("t")) / 3600)).alias("window_h"))
    mine = own.select("station", "miner").distinct().withColumn("_own", F.lit(True))
    rows = deliveries.join(window, ["station", "ware"]).join(mine, ["station", "miner"], "left").withColumn("_in", F.col("t") >= now - F.col("window_h") * 3600)
    amount = F.when(F.col("_in"), F.col("amount")).otherwise(0.0)
    sums = rows.groupBy("station", "ware", "window_h").agg(F.sum(amount).alias("_all"), F.sum(F.when(F.col("_own"), amount).otherwise(0.0)).alias("_mine"), F.count(F.when(F.col("_in") & F.col("_own"), 1)).alias("n"))
    return sums.select("station", "ware", "window_h", (F.col("_all") / F.col("window_h")).alias("observed"), (F.col("_mine") / F.col("window_h")).alias("own"), "n")


def pool_rates(pools: DataFrame) -> DataFrame:
    """pools (station, class, size, measured, hold, gap) with rate, source and more: trips an hour as measured, else the median of measured ones of the size, else assumed; and the miners that close the gap. Gaps count to a millionth."""
    usual = exact(pools.filter("measured > 0"), ["size"], "measured", {"_usual": 0.5})
    assumed = F.coalesce(*[F.when(F.col("size") == s, t) for s, t in TRIPS.items()], F.lit(1.0))
    out = pools.join(usual, "size", "left").withColumns({"rate": F.when(F.col("measured") > 0, F.col("measured")).otherwise(F.coalesce("_usual", assumed)), "source": F.when(F.col("measured") > 0, "measured").when(F.col("_usual").isNotNull(), "empire").otherwise("assumed")})
    per = F.col("hold") * F.col("rate")
    return out.withColumn("more", F.when(settled(F.col("gap")) <= 0, 0).when(per > 0, F.ceil(settled(F.col("gap") / per)))).drop("_usual")


#: Fixed value: what is left of a ware that counts as missing.
MISSING = 0.5


def remaining(entries: DataFrame, upgrades: DataFrame, parts: DataFrame, recipes: DataFrame) -> DataFrame:
    """(site, ware, amount): what the plans of sites still take.

    entries: (site, entry, macro, method, built), of which a site may list one
    several times; each counts once, those without an id every time. An unbuilt one
    takes what its macro and its upgrades (site, entry, macro) are made of: parts
    (macro, ware) and recipes (ware, method, input_ware, input_amount), of its
    method or else of `default`.
    """
    named = entries.filter("entry IS NOT NULL").groupBy("site", "entry").agg(F.min(F.struct("macro", "method")).alias("e"), F.max("built").alias("built")).select("site", "entry", "e.macro", "e.method", "built")
    open_ = named.unionByName(entries.filter("entry IS NULL").select("site", "entry", "macro", "method", "built")).filter("built = 0")
    every = open_.select("site", "macro", "method").unionByName(open_.join(upgrades.select("site", "entry", F.col("macro").alias("_up")), ["site", "entry"]).select("site", F.col("_up").alias("macro"), "method"))
    wares = every.groupBy("site", "macro", "method").agg(F.count("*").alias("n")).join(parts.select(F.lower("macro").alias("macro"), "ware"), "macro")
    taken = recipes.filter("input_ware IS NOT NULL AND input_ware <> ''")
    has = taken.select("ware", "method").distinct().withColumn("_has", F.lit(True))
    wares = wares.join(has, ["ware", "method"], "left").withColumn("method", F.when(F.col("_has"), F.col("method")).otherwise("default"))
    return wares.join(taken, ["ware", "method"]).groupBy("site", F.col("input_ware").alias("ware")).agg(F.sum(F.col("n") * F.col("input_amount")).alias("amount"))


def waiting(sites: DataFrame, offers: DataFrame, left: DataFrame, cargo: DataFrame) -> DataFrame:
    """(site, ware, needed, kind) of building sites (site) that wait for materials.

    kind `ordered`: what they buy, by their offers (site, ware, amount). Sites that
    buy nothing but have something left to build (remaining()) beyond what lies there
    (cargo: site, ware, amount) are `inactive`, in a row without a ware, and what
    they lack is `estimated`.
    """
    own = offers.join(sites.select("site").distinct(), "site", "left_semi").filter("amount > 0")
    ordered = own.select("site", "ware", F.round("amount").alias("needed"), F.lit("ordered").alias("kind"))
    held = cargo.groupBy("site", "ware").agg(F.sum("amount").alias("_held"))
    quiet = sites.select("site").distinct().join(own, "site", "left_anti")
    lacks = left.join(quiet, "site", "left_semi").join(held, ["site", "ware"], "left").withColumn("needed", F.col("amount") - F.coalesce("_held", F.lit(0.0))).filter(settled(F.col("needed")) > MISSING)
    estimated = lacks.select("site", "ware", "needed", F.lit("estimated").alias("kind"))
    inactive = lacks.select("site").distinct().select("site", F.lit(None).cast("string").alias("ware"), F.lit(None).cast("double").alias("needed"), F.lit("inactive").alias("kind"))
    return ordered.withColumn("ware", F.col("ware").cast("string")).unionByName(estimated.withColumn("ware", F.col("ware").cast("string"))).unionByName(inactive)
