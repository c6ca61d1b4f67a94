"""How a station's storage is shared out among its wares: rates of its modules, rations of its workers, pools of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import clamp, first_fragment

# The ware that sunlight scales, the method whose inputs aren't stored, hours of rations, units of a producing module.
SOLAR, PROCESSING, RATION_HOURS, UNITS_A_MODULE = "energycells", "processing", 4, 10


def usual(df: DataFrame, recipes: DataFrame, on: str, by: str = "method") -> DataFrame:
    """df with its recipe's columns and `used`, the method they are of: that of (on, by), else the default one; rows without either go."""
    more = [c for c in recipes.columns if c not in (on, by)]
    exact = recipes.select(on, by, F.struct(F.col(by).alias("used"), *more).alias("_exact"))
    other = recipes.filter(F.col(by) == "default").select(on, F.struct(F.col(by).alias("used"), *more).alias("_usual"))
    found = df.join(exact, [on, by], "left").join(other, on, "left").withColumn("_r", F.coalesce("_exact", "_usual")).filter("_r IS NOT NULL")
    return found.select(*[F.col(c) for c in df.columns], "_r.*")


def running(modules: DataFrame, makes: DataFrame, recipes: DataFrame, by_ware: DataFrame, by_module: DataFrame, sunlight: DataFrame) -> DataFrame:
    """What modules (station, macro, n) make: (station, macro, ware, used, units, seconds, amount, efficiency).

    makes: (macro, ware, method, scale, weight); recipes: (ware, method, seconds,
    amount, work). The efficiency is the one told for the ware (station, macro,
    ware, told), else the module's (station, macro, of_all), carried over to this
    recipe by the workers' share that it stands for, else 1; if none is told at all
    it is that of full work, and of sunlight (station, light) for solar goods.
    """
    told_any = not (by_ware.isEmpty() and by_module.isEmpty())
    known = usual(makes, recipes, "ware")
    least = known.filter("work > 0").groupBy("macro").agg(F.min("work").alias("_least"))
    rows = modules.join(known, "macro").join(least, "macro", "left").join(by_ware, ["station", "macro", "ware"], "left").join(by_module, ["station", "macro"], "left").join(sunlight, "station", "left")
    share = clamp((F.col("of_all") - 1) / F.col("_least"), 0.0, 1.0)
    carried = F.when(F.col("of_all").isNotNull(), F.when(F.col("_least").isNotNull() & (F.col("work") > 0), 1 + F.col("work") * share).otherwise(F.col("of_all")))
    bare = F.lit(1.0) if told_any else (1 + F.col("work")) * F.when(F.col("ware") == SOLAR, F.coalesce("light", F.lit(1.0))).otherwise(1.0)
    return rows.select("station", "macro", "ware", "used", (F.col("n") * F.col("scale") * F.col("weight")).alias("units"), "seconds", "amount", F.coalesce("told", carried, bare).alias("efficiency"))


def output(rows: DataFrame) -> DataFrame:
    """(station, ware, rate) an hour: a cycle gives whole units."""
    return rows.filter("seconds > 0").groupBy("station", "ware").agg(F.sum(F.floor(F.col("amount") * F.col("efficiency")) / F.col("seconds") * 3600 * F.col("units")).alias("rate"))


def intake(rows: DataFrame, inputs: DataFrame) -> DataFrame:
    """(station, ware, rate) an hour of inputs (ware, used, input, needed); efficiency doesn't raise it."""
    used = rows.filter((F.col("seconds") > 0) & (F.col("used") != PROCESSING)).join(inputs, ["ware", "used"])
    return used.groupBy("station", F.col("input").alias("ware")).agg(F.sum(F.col("needed") / F.col("seconds") * 3600 * F.col("units")).alias("rate"))


def rations(workforce: DataFrame, places: DataFrame, recipes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(station, ware, rate, buffer): what workers (station, race, amount) eat an hour, and the whole units kept for them.

    places: (station, places), the workers a station is built for; without any, those
    present count. They are shared among races as present, whole heads each.
    recipes: (need, method, seconds, amount), inputs: (used, ware, needed).
    """
    present = F.sum("amount").over(Window.partitionBy("station"))
    heads = workforce.withColumn("_all", present).join(places, "station", "left")
    basis = F.when(F.col("places") > 0, F.col("places")).otherwise(F.col("_all"))
    heads = heads.select("station", F.lit("work").alias("need"), F.col("race").alias("method"), F.floor(basis * F.coalesce(F.try_divide("amount", "_all"), F.lit(0.0))).alias("heads")).filter("heads > 0")
    eaten = usual(heads, recipes, "need").filter("amount > 0 AND seconds > 0").join(inputs, "used").withColumn("_rate", F.col("needed") / F.col("amount") / F.col("seconds") * 3600 * F.col("heads"))
    return eaten.groupBy("station", "ware").agg(F.sum("_rate").alias("rate"), F.sum(F.floor(F.col("_rate") * RATION_HOURS)).alias("buffer"))


def pooled(wares: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (station, ware) with transport, volume and the pool (grp) that the ware is kept in: groups (station, transport, grp)."""
    return rows.join(wares.select("ware", "transport", "volume"), "ware", "left").withColumn("volume", F.coalesce("volume", F.lit(1.0))).join(groups, ["station", "transport"], "left")


def allocate(out: DataFrame, into: DataFrame, food: DataFrame, wares: DataFrame, groups: DataFrame, caps: DataFrame) -> DataFrame:
    """(station, ware, transport, role, throughput, max_units) of producing stations.

    Of each pool (station, grp, cap) the rations' buffers go first; the rest is
    shared so that all wares made or used last equally long, the larger flow of a
    ware being its throughput. Wares out of the economy (wares.economy false) are
    not stocked as inputs.
    """
    into = into.join(wares.filter("economy = false").select("ware"), "ware", "left_anti")
    flow = out.withColumnRenamed("rate", "_out").join(into.withColumnRenamed("rate", "_in"), ["station", "ware"], "full_outer").join(food.withColumnRenamed("rate", "_eaten"), ["station", "ware"], "full_outer")
    flow = flow.join(caps.select("station").distinct(), "station", "left_semi")
    is_input = F.col("_in").isNotNull() & (F.col("_out").isNull() | (F.col("_in") > F.col("_out")))
    flow = flow.withColumns({"role": F.when(is_input, "input").when(F.col("_out").isNotNull(), "output").otherwise("food"), "_thru": F.when(is_input, F.col("_in")).otherwise(F.col("_out")), "buffer": F.coalesce("buffer", F.lit(0))})
    flow = pooled(wares, groups, flow).join(caps, ["station", "grp"], "left")
    pool = Window.partitionBy("station", "grp")
    left = F.coalesce("cap", F.lit(0.0)) - F.sum(F.col("buffer") * F.col("volume")).over(pool)
    need = F.sum(F.col("_thru") * F.col("volume")).over(pool)
    share = F.when(F.col("_thru").isNotNull() & (need > 0), F.col("_thru") * left / need).otherwise(0.0)
    return flow.select("station", "ware", "transport", "role", F.coalesce("_thru", "_eaten").alias("throughput"), (share + F.col("buffer")).alias("max_units"))


def equal_shares(rows: DataFrame, wares: DataFrame, groups: DataFrame, caps: DataFrame) -> DataFrame:
    """(station, ware, max_units): pools shared by volume alike among the wares (station, ware) that a station trades."""
    kept = pooled(wares, groups, rows.distinct()).join(caps, ["station", "grp"])
    return kept.select("station", "ware", (F.col("cap") / F.count("*").over(Window.partitionBy("station", "grp")) / F.col("volume")).alias("max_units"))


def proxy(held: DataFrame, wanted: DataFrame, inbound: DataFrame, sized: DataFrame) -> DataFrame:
    """(station, ware, max_units) of wares that no model sizes: held, open buys and what is on its way, each (station, ware, amount)."""
    every = held.select("station", "ware", "amount").unionByName(wanted.select("station", "ware", "amount")).unionByName(inbound.select("station", "ware", "amount"))
    return every.groupBy("station", "ware").agg(F.sum("amount").alias("max_units")).join(sized.select("station", "ware").distinct(), ["station", "ware"], "left_anti")


def munition(stock: DataFrame, holds: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """(station, category, amount, capacity) of units (station, macro, amount) by the first fragment of their macro.

    holds: (station, storage, modules); capacity is the storage of all a station's
    parts, and ten for each producing module.
    """
    room = holds.groupBy("station").agg((F.sum("storage") + UNITS_A_MODULE * F.sum("modules")).alias("capacity"))
    return stock.groupBy("station", first_fragment("macro", kinds, "other").alias("category")).agg(F.sum("amount").alias("amount")).join(room, "station", "left")


def limit(manual_buy: Column, manual_max: Column, computed: Column, source: Column) -> Column:
    """The limit that holds: of buying by hand, of stock by hand, or computed; a proxy is no limit."""
    return F.coalesce(manual_buy, manual_max, F.when(source != "proxy", computed))


def blocked(stock: Column, limit: Column) -> Column:
    """Whether storage is all but full."""
    return F.coalesce((limit > 0) & (stock >= 0.95 * limit), F.lit(False))
