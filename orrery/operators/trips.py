"""What a ship earns on a lane, how many ships a haul takes, and scores that weigh a site's factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import settled

# The part of a travel drive's speed that ships keep, metres a second on highways, sizes that use them, offers of a book that are shown,
# by what part the recent profit must differ from the usual.
CRUISE, HIGHWAY = 0.9, 10_000.0
SMALL = ("S", "M")
BOOK = 10
TREND = 0.15


def profit(depth: Column, hold: Column, volume: Column, spread: Column) -> Column:
    """Of one trip: as many whole units as the lane takes and the hold carries. Null without a hold or a volume."""
    fits = F.when((hold > 0) & (volume > 0), hold / volume)
    return F.when(fits.isNotNull(), F.floor(settled(F.least(depth, fits))) * spread)


def seconds(plain_km: Column, highway_km: Column, quick_plain_km: Column, quick_highway_km: Column, speed: Column, size: Column, dock: Column, highways: bool = True, cruise: float = CRUISE, highway: float = HIGHWAY) -> Column:
    """Of one way: plain space at the cruise part of a ship's speed, highways at theirs for small ships, others at their own; and `dock` seconds.

    Small ships take the quick way where it is known. Null without a speed or a way.
    """
    own = speed * cruise
    small = size.isin(*SMALL) & F.lit(highways)
    quick = small & quick_plain_km.isNotNull()
    plain, fast = F.when(quick, quick_plain_km).otherwise(plain_km), F.when(quick, quick_highway_km).otherwise(highway_km)
    way = plain * 1000 / own + fast * 1000 / F.when(small, F.lit(highway)).otherwise(own)
    return F.when((speed > 0) & plain_km.isNotNull(), way + dock)


def per_hour(profit: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, profit * 3600 / seconds)


def earnings(lanes: DataFrame, ships: Sequence[Mapping], dock: Mapping[str, float], reserve: bool = False) -> DataFrame:
    """lanes (units, reserve_units, volume, spread, plain_km, highway_km, quick_plain_km, quick_highway_km) with preset, size, profit, seconds and per_hour of each of the ships.

    ships: the presets to compare (preset, size, hold, speed), a row of a lane each.
    dock: seconds of loading by size. `reserve` takes what lies in store as well as
    what is offered.
    """
    wait = F.coalesce(*[F.when(F.col("size") == s, F.lit(float(t))) for s, t in dock.items()], F.lit(0.0))
    kinds = F.array(*[F.struct(F.lit(s["preset"]).alias("preset"), F.lit(s["size"]).alias("size"), F.lit(s["hold"]).cast("double").alias("hold"), F.lit(s["speed"]).cast("double").alias("speed")) for s in ships])
    out = lanes.withColumn("_ship", F.explode(kinds)).select(*lanes.columns, "_ship.*")
    out = out.withColumns({"profit": profit(F.col("reserve_units" if reserve else "units"), F.col("hold"), F.col("volume"), F.col("spread")), "seconds": seconds(*map(F.col, ("plain_km", "highway_km", "quick_plain_km", "quick_highway_km", "speed", "size")), wait)})
    return out.withColumn("per_hour", per_hour(F.col("profit"), F.col("seconds")))


def traders(haul: Column, hold: Column, round_trip: Column) -> Column:
    """Ships that carry `haul` an hour, null where nothing is hauled or there is no way."""
    return F.when((round_trip > 0) & (haul > 0), F.ceil(settled(haul / (hold * 3600 / round_trip))))


def score(good: Mapping[str, float], bad: Mapping[str, float]) -> Column:
    """Per cent of the weights of factors (columns from 0 to 1) that a site has; bad ones count against it. Weights of zero in sum count as one."""
    total = sum(good.values()) + sum(bad.values()) or 1.0
    sums = sum((F.col(c) * w for c, w in good.items()), F.lit(0.0)) - sum((F.col(c) * w for c, w in bad.items()), F.lit(0.0))
    return sums * 100 / total


def book(offers: DataFrame, part: float) -> DataFrame:
    """The BOOK best offers (ware, side, station, price, amount) of a ware and side with rank, of those that offer enough.

    Enough is the cube of `part` (0 to 1) of the ware's greatest amount, one at
    least, rounded half up. Buyers are ranked by the highest price, sellers by the
    lowest; of equal prices the lesser station comes first.
    """
    most = offers.groupBy("ware").agg(F.floor(F.greatest(F.lit(1.0), F.max("amount").cast("double")) * part**3 + 0.5).alias("_least"))
    enough = offers.join(most, "ware").filter(F.col("amount") >= F.col("_least")).drop("_least")
    order = [F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price")), F.col("station"), F.col("amount").desc()]
    return enough.withColumn("rank", F.row_number().over(Window.partitionBy("ware", "side").orderBy(*order))).filter(F.col("rank") <= BOOK)


def trend(recent: Column, usual: Column) -> Column:
    """`up`, `down` or empty: whether recent profit differs from the usual by more than TREND of it."""
    return F.when(recent > usual * (1 + TREND), "up").when(recent < usual * (1 - TREND), "down").otherwise("")


def change(value: Column, bare: Column) -> Column:
    """Per cent by which a modification changes a value, to one decimal; null where it doesn't, or where there is nothing to compare."""
    return F.when((bare != 0) & (F.abs(value - bare) > 1e-9), F.round((value / bare - 1) * 100, 1))
