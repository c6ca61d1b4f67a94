"""Where to build: sectors rated for each ware by what is wanted, made and to be had within a few jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import settled

# Jumps that count as near and that hostile sectors are looked for in, sectors kept for a ware, hours that open
# offers spread over, the most that inputs can be in supply, kilometres of a way within a sector, and the weights of the cut.
RADIUS, HOSTILE_SCAN, TOP, BACKLOG_HOURS, INPUT_CAP, IN_SECTOR_KM = 4, 6, 10, 24.0, 3.0, 50.0
WEIGHTS = {"demand": 0.35, "inputs": 0.25, "safety": 0.15, "food": 0.10, "competition": -0.15}


def near(hops: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """(sector, ware, names): what lies within the hops (source, node, hops) of each sector, less by 1 / (1 + hops). Joins by the hop table, which the radius bounds."""
    own = hops.join(values.withColumnRenamed("sector", "node"), "node")
    return own.groupBy(F.col("source").alias("sector"), "ware").agg(*[F.sum(F.col(n) / (1 + F.col("hops"))).alias(n) for n in names])


def hostility(hops: DataFrame, hostile: DataFrame) -> DataFrame:
    """(sector, hostile_d): jumps to the nearest hostile sector (sector), of the hops (source, node, hops) from these."""
    own = hops.filter(F.col("hops") <= HOSTILE_SCAN).join(hostile.select(F.col("sector").alias("source")), "source", "left_semi")
    return own.groupBy(F.col("node").alias("sector")).agg(F.min("hops").alias("hostile_d"))


def supply(grid: DataFrame, inputs: DataFrame, flows: DataFrame, hops: DataFrame, yields: DataFrame) -> DataFrame:
    """(sector, ware, input_ratio, bottleneck): of a ware's inputs (ware, input, ord, needed) that which is scarcest near the sector, by what is made beyond what is used there, or can be mined against the upper quartile of all sectors that have it."""
    spare = near(hops, flows, "made_act", "used_act").select("sector", F.col("ware").alias("input"), F.greatest(F.col("made_act") - F.col("used_act"), F.lit(0.0)).alias("_spare"))
    usual = yields.filter("amount > 0").groupBy("ware").agg(F.percentile("amount", 0.75).alias("_usual"))  # a number for each sector
    mined = near(hops, yields, "amount").join(usual, "ware").select("sector", F.col("ware").alias("input"), (F.col("amount") / F.col("_usual")).alias("_mined"))
    rows = grid.join(inputs, "ware").join(spare, ["sector", "input"], "left").join(mined, ["sector", "input"], "left")
    had = F.when(F.col("needed") > 0, F.coalesce("_spare", F.lit(0.0)) / F.col("needed")).otherwise(INPUT_CAP)
    ratio = settled(F.least(F.lit(INPUT_CAP), F.greatest(had, F.coalesce("_mined", F.lit(0.0)))), 9)
    worst = rows.withColumn("ratio", ratio).groupBy("sector", "ware").agg(F.min_by(F.struct("ratio", "input"), F.struct("ratio", "ord")).alias("w"))
    return worst.select("sector", "ware", F.col("w.ratio").alias("input_ratio"), F.when(F.col("w.ratio") < INPUT_CAP, F.col("w.input")).alias("bottleneck"))


def haul(hops: DataFrame, flows: DataFrame, backlog: DataFrame, legs: DataFrame) -> DataFrame:
    """(sector, ware, km_plain, km_highway): the mean way to where the ware is wanted, weighed by how much; legs: (source, node, plain_km, highway_km) between sectors. Places without a way don't count."""
    wanted = flows.select("ware", "sector", F.col("used").alias("w")).unionByName(backlog.select("ware", "sector", (F.col("amount") / BACKLOG_HOURS).alias("w"))).groupBy("ware", F.col("sector").alias("node")).agg(F.sum("w").alias("w")).filter("w > 0")
    rows = hops.join(wanted, "node").join(legs, ["source", "node"], "left").withColumn("_w", F.col("w") / (1 + F.col("hops")))
    here = F.col("source") == F.col("node")
    plain, quick = F.when(here, IN_SECTOR_KM).otherwise(F.col("plain_km")), F.when(here, 0.0).otherwise(F.col("highway_km"))
    rows = rows.withColumns({"_p": plain, "_q": quick}).filter("_p IS NOT NULL")
    mean = lambda c: F.round(settled(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")), 1)
    return rows.groupBy(F.col("source").alias("sector"), "ware").agg(mean("_p").alias("km_plain"), mean("_q").alias("km_highway"))


def advice(candidates: DataFrame, goods: DataFrame, inputs: DataFrame, hops: DataFrame, hostile_hops: DataFrame, hostile: DataFrame, flows: DataFrame, backlog: DataFrame, food: DataFrame, yields: DataFrame, legs: DataFrame) -> DataFrame:
    """The best sectors of candidates (sector) for each of goods (ware), with what they are rated by.

    flows: (ware, sector, made, used, made_act, used_act), an hour, as stations could
    and as stocks show; backlog: (ware, sector, amount) of open offers; food: (ware).
    Demand is what is used near plus a day's share of the backlog, on either basis;
    each factor is set against the best sector of the ware. The TOP sectors by the
    better of both bases stay (the lesser name first where they are equal), and of
    these those whose surroundings want the ware at all.
    """
    grid = candidates.select("sector").distinct().join(goods.select("ware").distinct(), F.lit(True))  # a rating for each
    own = grid.join(near(hops, flows, "made", "used", "made_act", "used_act"), ["sector", "ware"], "left").join(near(hops, backlog, "amount").withColumnRenamed("amount", "backlog"), ["sector", "ware"], "left")
    fed = near(hops, flows.join(food, "ware", "left_semi"), "made").groupBy("sector").agg(F.sum("made").alias("food"))
    own = own.join(fed, "sector", "left").fillna(0.0, ["made", "used", "made_act", "used_act", "backlog", "food"])
    own = own.join(supply(grid, inputs, flows, hops, yields), ["sector", "ware"], "left").join(hostility(hostile_hops, hostile), "sector", "left").join(haul(hops, flows, backlog, legs), ["sector", "ware"], "left")
    own = own.fillna(INPUT_CAP, ["input_ratio"]).fillna(HOSTILE_SCAN, ["hostile_d"])
    part = {"nd": F.col("used") + F.col("backlog") / BACKLOG_HOURS, "nda": F.col("used_act") + F.col("backlog") / BACKLOG_HOURS, "nc": F.col("made"), "nca": F.col("made_act"), "nw": F.col("food")}
    most = own.groupBy("ware").agg(*[F.max(c).alias(f"_{k}") for k, c in part.items()])
    share = {k: F.when(F.col(f"_{k}") > 0, c / F.col(f"_{k}")).otherwise(0.0) for k, c in part.items()}
    own = own.join(most, "ware").withColumns(share | {"ni": F.col("input_ratio") / INPUT_CAP, "ns": F.col("hostile_d") / F.lit(float(HOSTILE_SCAN))})

    def rated(demand: str, competition: str) -> Column:
        return WEIGHTS["demand"] * F.col(demand) + WEIGHTS["inputs"] * F.col("ni") + WEIGHTS["safety"] * F.col("ns") + WEIGHTS["food"] * F.col("nw") + WEIGHTS["competition"] * F.col(competition)

    own = own.withColumn("rating", settled(F.greatest(rated("nd", "nc"), rated("nda", "nca")), 9))
    place = F.row_number().over(Window.partitionBy("ware").orderBy(F.desc("rating"), "sector"))
    own = own.withColumn("place", place).filter(F.col("place") <= TOP).filter("nd > 0 OR nda > 0 OR backlog > 0")
    return own.select("ware", "sector", "place", "rating", F.col("used").alias("demand"), "backlog", F.col("made").alias("competition"), F.col("used_act").alias("demand_act"), F.col("made_act").alias("competition_act"), "input_ratio", "bottleneck", "hostile_d", "food", "km_plain", "km_highway", "nd", "nc", "nda", "nca", "ni", "ns", "nw")
