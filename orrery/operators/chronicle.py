"""What happened to an empire's objects: its trades by who made them, its losses by who caused them, bounties, claims and bails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import empty_to_null

#: Fixed value: the short code of the player's faction.
PLAYER = "PLA"


def label(name: Column, code: Column) -> Column:
    """`name (code)`, the name alone without a code; null without a name."""
    name, code = empty_to_null(name), empty_to_null(code)
    return F.when(code.isNull(), name).otherwise(F.concat(name, F.lit(" ("), code, F.lit(")")))


def trade_records(trades: DataFrame, leaders: DataFrame) -> DataFrame:
    """(t, ware, amount, money, partner, object, via): a record for each object that a trade of the player with others counts for.

    trades: t, ware, amount, money and of each side (seller_, buyer_) faction, name,
    code, proxy_name and proxy_code. Sales bring money, buys cost it; trades within
    the empire and among others have no record. Where a subordinate (proxy) carried
    it out, one record is its own and one its commander's, with the subordinate as
    `via`. leaders (code, leader): who leads an object goes before its label; of
    several the least. What has no name has no record; a partner without one is `?`.
    A join with leaders is all that moves, so a busy object is no hot group beyond
    what Spark splits itself.
    """
    sold = F.col("seller_faction").eqNullSafe(PLAYER)
    rows = trades.filter(sold != F.col("buyer_faction").eqNullSafe(PLAYER))
    own, other = (lambda c: F.when(sold, F.col(f"seller_{c}")).otherwise(F.col(f"buyer_{c}"))), (lambda c: F.when(sold, F.col(f"buyer_{c}")).otherwise(F.col(f"seller_{c}")))
    rows = rows.select(
        "t", "ware", F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"), (F.when(sold, 1).otherwise(-1) * F.coalesce(F.col("money").cast("long"), F.lit(0))).alias("money"),
        F.concat(F.coalesce(other("faction"), F.lit("?")), F.lit(": "), F.coalesce(label(other("name"), other("code")), F.lit("?"))).alias("partner"),
        own("code").alias("_code"), label(own("name"), own("code")).alias("_own"), own("proxy_code").alias("_by"), label(own("proxy_name"), own("proxy_code")).alias("_proxy"),
    )
    led = leaders.filter("code IS NOT NULL AND leader IS NOT NULL").groupBy("code").agg(F.min("leader").alias("leader"))
    for name, key in (("_own", "_code"), ("_proxy", "_by")):
        rows = rows.join(led.select(F.col("code").alias(key), F.col("leader").alias("_leader")), key, "left").withColumn(name, F.when(F.col("_leader").isNull(), F.col(name)).otherwise(F.concat("_leader", F.lit(" - "), F.col(name)))).drop("_leader")
    record = lambda object_, via: F.struct(object_.alias("object"), via.alias("via"))
    both = F.array(record(F.coalesce("_proxy", "_own"), F.lit("")), F.when(F.col("_proxy").isNotNull(), record(F.col("_own"), F.col("_proxy"))))
    return rows.select("t", "ware", "amount", "money", "partner", F.explode(F.filter(both, lambda x: x["object"].isNotNull())).alias("r")).select("t", "ware", "amount", "money", "partner", "r.*")


def losses(destroyed: DataFrame, shorts: DataFrame, now: float) -> DataFrame:
    """(t, hours_ago, object, sector, killer, faction) of destroyed (t, object, sector, killer).

    faction: the three letters that a killer's name begins with, as a word of their
    own, where shorts (short) knows them; else `?`.
    """
    name = F.trim(F.coalesce("killer", F.lit("")))
    tag = F.when(~F.substring(name, 4, 1).rlike(r"[\p{L}\p{N}_]"), F.substring(name, 1, 3))
    known = shorts.select(F.col("short").alias("faction")).filter("length(faction) = 3 AND faction = upper(faction)").distinct()
    out = destroyed.withColumn("_tag", tag).join(known, F.col("_tag") == F.col("faction"), "left")
    return out.select("t", F.round((F.lit(now) - F.col("t")) / 3600, 1).alias("hours_ago"), F.coalesce("object", F.lit("?")).alias("object"), F.coalesce("sector", F.lit("?")).alias("sector"), F.coalesce("killer", F.lit("")).alias("killer"), F.coalesce("faction", F.lit("?")).alias("faction"))


def losses_by_faction(found: DataFrame) -> DataFrame:
    """(faction, losses) of losses(), most first."""
    return found.groupBy("faction").agg(F.count("*").alias("losses")).orderBy(F.col("losses").desc(), "faction")


def bounties(rewards: DataFrame, now: float) -> DataFrame:
    """(who, kind, rewards, bounty, factions, hours_ago) of rewards (reward, ship, code, kind, faction, bounty, t).

    A reward has a row for each ship that shared it and each faction that paid; a
    ship is credited the whole of each row, a reward without an amount counts as one
    of nothing. hours_ago: since the last.
    """
    who = F.concat(F.coalesce("ship", F.lit("?")), F.lit(" ("), F.coalesce("code", F.lit("?")), F.lit(")"))
    rows = rewards.select(who.alias("who"), F.coalesce(empty_to_null("kind"), F.lit("?")).alias("kind"), "reward", "faction", "bounty", "t")
    sums = rows.groupBy("who", "kind", "reward", "faction").agg(F.sum("bounty").alias("bounty"), F.max("t").alias("t"))  # counted before it moves
    out = sums.groupBy("who", "kind").agg(F.count_distinct("reward").alias("rewards"), F.coalesce(F.sum("bounty"), F.lit(0.0)).alias("bounty"), F.count_distinct("faction").alias("factions"), F.max("t").alias("t"))
    return out.select("who", "kind", "rewards", F.round("bounty").cast("long").alias("bounty"), "factions", F.round((F.lit(now) - F.col("t")) / 3600, 1).alias("hours_ago"))


def bounty_total(rewards: DataFrame) -> DataFrame:
    """(rewards, bounty), a row: each reward once, however many ships shared it."""
    once = rewards.groupBy("reward").agg(F.max("bounty").alias("bounty"))
    return once.agg(F.count("*").alias("rewards"), F.coalesce(F.sum("bounty"), F.lit(0.0)).alias("bounty"))


def claims(found: DataFrame, now: float) -> DataFrame:
    """(hours_ago, finder, sector, claimed), newest first, of found (t, finder, finder_code, sector, claimed, claimed_code)."""
    return found.orderBy(F.col("t").desc(), "finder", "claimed").select(F.round((F.lit(now) - F.col("t")) / 3600, 1).alias("hours_ago"), label(F.col("finder"), F.col("finder_code")).alias("finder"), "sector", label(F.col("claimed"), F.col("claimed_code")).alias("claimed"))
