"""What modifications of equipment do, and what ships and shields are capable of with them."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stats of which less is better, by kind of equipment, and those that add up where others multiply.
LESS_IS_BETTER = {"weapon": ("chargetime",), "engine": ("travelattacktime", "travelchargetime"), "shield": ("rechargedelay",), "ship": ("mass", "drag", "radarcloak")}
ADDED = ("radarcloak", "hidecargochance", "regiondamage", "countermeasurecapacity", "deployablecapacity", "missilecapacity", "unitcapacity")
#: What a stat is worth that can't be divided by.
ENDLESS = 1e9


def realised(mods: DataFrame, kind: str, roll: str = "optimal") -> DataFrame:
    """(ware, stat, value): what modifications (ware, stat, min, max, forced, bonuses of stat, min, max) do for certain.

    That is their own stat and the bonuses that are forced. roll: `min`, `max` or the
    `optimal` end for the player. Several values of a stat multiply, those of ADDED
    add up; of a weapon's the last one counts.
    """
    part = lambda b: F.struct(b["stat"].alias("stat"), b["min"].alias("min"), b["max"].alias("max"))
    every = F.concat(F.array(F.struct("stat", "min", "max")), F.when(F.col("forced"), F.transform("bonuses", part)).otherwise(F.array().cast("array<struct<stat:string,min:double,max:double>>")))
    rows = mods.select("ware", F.posexplode(every).alias("ord", "p")).select("ware", "ord", "p.*")
    least = F.lit(roll == "min") | (F.lit(roll == "optimal") & F.col("stat").isin(*LESS_IS_BETTER[kind]))
    low, high = F.least("min", "max"), F.greatest("min", "max")
    value = F.when(least, low if kind == "weapon" else F.col("min")).otherwise(high if kind == "weapon" else F.col("max"))
    rows = rows.withColumn("value", value)
    if kind == "weapon":
        total = F.max_by("value", "ord")
    else:
        total = F.when(F.col("stat").isin(*ADDED), F.sum("value")).otherwise(F.product("value"))
    return rows.groupBy("ware", "stat").agg(total.alias("value"))


def effects(rows: DataFrame) -> DataFrame:
    """(ware, effects): a map of the stats of realised() to their values; it has as many entries as there are stats."""
    return rows.filter("stat IS NOT NULL").groupBy("ware").agg(F.map_from_entries(F.collect_list(F.struct("stat", "value"))).alias("effects"))


def factor(stat: str) -> Column:
    """By how much the map `effects` of a row changes a stat: one where it says nothing, or where the row has none."""
    return F.coalesce(F.try_element_at("effects", F.lit(stat)), F.lit(1.0))


def usual_engine(engines: DataFrame) -> DataFrame:
    """engines, one of each size: an allround one of mark one, or else of another mark, or else any; of several the first by type, mark and macro."""
    all_, first = F.col("type").eqNullSafe("allround"), F.col("mk") == 1
    rank = F.when(all_ & first, 0).when(all_, 1).otherwise(2)
    rest = [c for c in engines.columns if c != "size"]
    order = F.struct(rank.alias("r"), F.coalesce("type", F.lit("")).alias("type"), "mk", "macro")
    return engines.filter("size IS NOT NULL").groupBy("size").agg(F.min_by(F.struct(*rest), order).alias("v")).select("size", "v.*")


def handling(rows: DataFrame, keep: Collection[str]) -> DataFrame:
    """(keep and stats) of ships with their engine's and thruster's columns (see game_files) and `effects`, null without a modification.

    Speeds are thrust by drag, accelerations thrust by mass or inertia, times as they
    are; an engine without an acceleration of its boost has one of one. A drag or an
    inertia of zero gives null.
    """
    over = lambda a, b: F.try_divide(a, b)
    mass = F.coalesce(F.nullif("mass", F.lit(0.0)), F.lit(1.0))
    forward = F.col("forward") * factor("forwardthrust")
    strafe = F.col("strafe") * factor("strafethrust")
    spin = factor("rotationthrust")
    turn = (F.col("pitch") + F.col("yaw")) / 2 * spin
    push = F.coalesce(F.nullif(F.col("boost_acceleration") * factor("boostacc"), F.lit(0.0)), F.lit(1.0))
    sidewise = F.coalesce(F.nullif(factor("strafeacc"), F.lit(0.0)), F.lit(1.0))
    stats = {
        "forward_speed": over(forward, F.col("drag_forward")),
        "forward_accel": forward / mass,
        "reverse_speed": over(F.col("reverse"), F.col("drag_reverse")),
        "strafe_speed": over(strafe, F.col("drag_horizontal")),
        "strafe_accel": strafe / mass * sidewise,
        "boost_speed": over(forward * F.col("boost_thrust") * factor("boostthrust"), F.col("drag_forward")),
        "boost_duration": F.col("boost_duration") * factor("boostduration"),
        "boost_accel": forward * push / mass,
        "travel_speed": over(forward * F.col("travel_thrust") * factor("travelthrust"), F.col("drag_forward")),
        "travel_charge": F.col("travel_charge") * factor("travelchargetime"),
        "travel_attack": F.col("travel_attack") * factor("travelattacktime"),
        "turn_rate": over(turn, (F.col("drag_pitch") + F.col("drag_yaw")) / 2),
        "turn_accel": over(turn, (F.col("inertia_pitch") + F.col("inertia_yaw")) / 2),
        "roll_rate": over(F.col("roll") * spin, F.col("drag_roll")),
    }
    return rows.select(*keep, *[v.alias(k) for k, v in stats.items()])


def recovery(shields: DataFrame, keep: Collection[str]) -> DataFrame:
    """(keep, capacity, rate, delay, refill) of shields (capacity, rate, delay) with `effects`: refill is the time from empty to full, the delay alone for one that doesn't recover."""
    capacity, rate, delay = F.col("capacity") * factor("capacity"), F.col("rate") * factor("rechargerate"), F.col("delay") * factor("rechargedelay")
    return shields.select(*keep, capacity.alias("capacity"), rate.alias("rate"), delay.alias("delay"), (delay + F.coalesce(F.try_divide(capacity, rate), F.lit(0.0))).alias("refill"))


def goodness(stat: Column, value: Column) -> Column:
    """A number that is greater where a hull's stat is better, to compare modifications by: a cloak turned round, the inverse of what should be little, all else as it is."""
    little = stat.isin(*[s for s in LESS_IS_BETTER["ship"] if s not in ADDED])
    return F.when(stat == "radarcloak", -value).when(little, F.coalesce(F.try_divide(F.lit(1.0), value), F.lit(ENDLESS))).otherwise(value)


def compared(rows: DataFrame, stats: list[str]) -> DataFrame:
    """(ware, a column a stat) of realised() rows of hulls: the goodness of each stat; what a modification doesn't change is neutral."""
    neutral = {s: 0.0 if s in ADDED else 1.0 for s in stats}
    cells = [F.coalesce(F.max(F.when(F.col("stat") == s, F.col("value"))), F.lit(neutral[s])).alias(s) for s in stats]
    return rows.groupBy("ware").agg(*cells).select("ware", *[goodness(F.lit(s), F.col(s)).alias(s) for s in stats])
