"""Rows from the wordings of log entries, as Column expressions.

Each reader takes a log (time, category, title, text, money in cents) and gives
(rows, unread): entries that its filter takes but whose wording it doesn't know
come back as unread (kind, sample) instead of being lost. A null title or text
counts as empty; an entry without money has none.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The wordings of the log's entries, the token that parts lines, and how an object's code looks.
BREAK = "[\\012]"
CODE = "[A-Z]{3}-[0-9]{3}"
DESTROYED, REWARD, FOUND, BAILED = " was destroyed.", "Combat Reward", "Found Abandoned Ship", "Forced pilot to leave ship "
SURPLUS_OF, SURPLUS_FROM, PIRATES, POLICE, PAID = "Received surplus of", "Received surplus from", "Pirate Harassment", "Police Interdiction", ". They have paid"


def entries(log: DataFrame) -> DataFrame:
    return log.withColumns({c: F.coalesce(c, F.lit("")) for c in ("category", "title", "text")})


def labelled(label: str) -> Column:
    """What a line of the text says after its label; null without such a line."""
    lines = F.transform(F.split("text", "\\[\\\\012\\]"), lambda x: F.trim(x))
    own = F.filter(lines, lambda x: x.startswith(f"{label}: "))
    return F.trim(F.substring(F.try_element_at(own, F.lit(1)), len(label) + 3, 1 << 20))


def named(c: Column) -> tuple[Column, Column]:
    """(name, code) of `<name> (<code>)` or `<name> <code>`; the name alone where there is no code."""
    code = F.nullif(F.regexp_extract(c, f"({CODE})\\)?$", 1), F.lit(""))
    return F.when(code.isNull(), c).otherwise(F.trim(F.regexp_replace(c, f"\\(?{CODE}\\)?$", ""))), code


def parted(found: DataFrame, ok: Column, kind: str) -> tuple[DataFrame, DataFrame]:
    known = F.coalesce(ok, F.lit(False))
    return found.filter(known), found.filter(~known).select(F.lit(kind).alias("kind"), F.concat_ws(" :: ", "title", "text").alias("sample"))


def services(log: DataFrame, title: str, words: str, commodity: str) -> tuple[DataFrame, DataFrame]:
    """`<faction> <ship> (<code>)<words><station> (<code>). They have paid ...`, in the text or else in the title, as sales."""
    own = entries(log).filter((F.col("category") == "upkeep") & (F.col("title") == title))
    source = F.when(F.contains("text", F.lit(words)), F.col("text")).otherwise(F.col("title"))
    good, bad = parted(own.withColumn("_s", source), F.contains(source, F.lit(words)), "services")
    before = F.substring_index("_s", words, 1)
    after = F.substring_index(F.expr(f"substr(_s, instr(_s, '{words}') + {len(words)})"), PAID, 1)
    buyer, seller = named(F.expr("substr(_b, instr(_b, ' ') + 1)")), named(F.col("_a"))
    good = good.withColumns({"_b": before, "_a": after})
    return good.select("time", F.floor(F.coalesce("money", F.lit(0)) / 100).alias("money"), seller[0].alias("seller_name"), seller[1].alias("seller_code"), F.lit(1).alias("amount"), F.lit(commodity).alias("commodity"), F.substring_index("_b", " ", 1).alias("buyer_faction"), buyer[0].alias("buyer_name"), buyer[1].alias("buyer_code")), bad


def destroyed(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(time, object, location, killer); killer is null where none is named."""
    own = entries(log).filter((F.col("category") == "upkeep") & F.col("title").endswith(DESTROYED))
    good, bad = parted(own, labelled("Location").isNotNull(), "destroyed")
    return good.select("time", F.expr(f"left(title, length(title) - {len(DESTROYED)})").alias("object"), labelled("Location").alias("location"), labelled("Destroyed by").alias("killer")), bad


def rewards(log: DataFrame, keys: Sequence[str] = ("time",)) -> tuple[DataFrame, DataFrame]:
    """A row for each credited ship or station; keys tell entries apart, nth the rows of one, so that its payout can be counted once (nth = 1). A reputation of `<1` counts as 0.5; the bounty is the entry's money."""
    own = entries(log).filter(F.col("title") == REWARD)
    good, bad = parted(own, labelled("Credited To").isNotNull(), "reward")
    said = labelled("Reputation")
    reputation = F.when(said == "+<1", 0.5).otherwise(F.expr("try_cast(substr(_r, 2) AS double)"))
    good = good.withColumns({"_r": said, "_c": labelled("Credited To")})
    kept = F.filter(F.split(F.element_at(F.split("_c", ":", 2), -1), ","), lambda x: F.rtrim(x).rlike(f"\\({CODE}\\)$"))
    one = lambda x: F.struct(F.trim(F.substr(x, F.lit(1), F.length(x) - 9)).alias("name"), F.substr(x, F.length(x) - 7, F.lit(7)).alias("code"))  # noqa: E731  what stands before the brackets, and in them
    each = F.posexplode(F.transform(kept, lambda x: one(F.rtrim(x))))
    kind = F.when(F.col("_c").startswith("Ships:"), "ship").when(F.col("_c").startswith("Stations:"), "station").otherwise("")
    found = good.select(*keys, labelled("Faction").alias("faction"), labelled("Station").alias("station"), labelled("Sector").alias("sector"), kind.alias("kind"), (F.col("money") / 100).alias("bounty"), reputation.alias("reputation"), each.alias("nth", "_e"))
    return found.withColumns({"nth": F.col("nth") + 1, "name": F.col("_e.name"), "code": F.col("_e.code")}).drop("_e"), bad


def claims(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`<finder> <code> in <sector>`, then `Found abandoned ship <name> <code>.`"""
    lines = F.split("text", "\\[\\\\012\\]")
    first, second = F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2))
    first_ok = F.regexp_like(first, F.lit(f"^.+ {CODE} in .+"))
    second_ok = F.regexp_like(second, F.lit(f"^Found abandoned ship .+ {CODE}"))
    good, bad = parted(entries(log).filter(F.col("title") == FOUND), first_ok & second_ok, "claim")
    finder = f"^(.*?) ({CODE}) in (.+)$"
    claimed = f"^Found abandoned ship (.*?) ({CODE})"
    told = {"finder": (first, finder, 1), "finder_code": (first, finder, 2), "sector": (first, finder, 3), "claimed": (second, claimed, 1), "claimed_code": (second, claimed, 2)}
    return good.select("time", *[F.trim(F.regexp_extract(c, p, g)).alias(k) for k, (c, p, g) in told.items()]), bad


def bails(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`Forced pilot to leave ship <ship> in sector <sector>.`"""
    pattern = f"^{BAILED}(.+) in sector (.+?)\\.?$"
    good, bad = parted(entries(log).filter(F.col("title").startswith(BAILED)), F.regexp_like("title", F.lit(pattern)), "bail")
    return good.select("time", F.regexp_extract("title", pattern, 1).alias("ship"), F.regexp_extract("title", pattern, 2).alias("sector")), bad


def transfers(log: DataFrame, managers: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(time, money, station_id, station_code, station_name) of both wordings of a surplus.

    managers: (manager_name, manager_id), stations: (station_id, code, name,
    manager_id). Names that several bear give a row for each.
    """
    own = entries(log).filter(F.col("category") == "upkeep")
    older = f"^{SURPLUS_OF} (.+) Credits from (.+?)\\.*$"
    newer = f"^{SURPLUS_FROM} (.+?) in .+"
    a, bad_a = parted(own.filter(F.contains("title", F.lit(SURPLUS_OF))), F.regexp_like("title", F.lit(older)), "transfer")
    b, bad_b = parted(own.filter(F.contains("title", F.lit(SURPLUS_FROM))), F.regexp_like("title", F.lit(newer)), "transfer")
    amount = F.expr("try_cast(replace(_m, ',', '') AS double)")
    a = a.select("time", F.regexp_extract("title", older, 1).alias("_m"), F.regexp_extract("title", older, 2).alias("manager_name")).join(managers, "manager_name", "left").join(stations, "manager_id", "left")
    b = b.select("time", "money", F.regexp_extract("title", newer, 1).alias("name")).join(stations, "name", "left")
    out = a.select("time", amount.alias("money"), "station_id", F.col("code").alias("station_code"), F.col("name").alias("station_name"))
    return out.unionByName(b.select("time", (F.col("money") / 100).alias("money"), "station_id", F.col("code").alias("station_code"), F.col("name").alias("station_name"))), bad_a.union(bad_b)


def _stopped(log: DataFrame, title: str, kind: str, middle: str) -> tuple[DataFrame, DataFrame]:
    """Entries of three lines: `<ship> <code> in <sector>`, one with `middle`, and `Response: <response>`, which is the last."""
    lines = F.transform(F.split("text", "\\[\\\\012\\]"), lambda x: F.trim(x))
    own = entries(log).filter(F.contains("title", F.lit(title))).withColumns({"_l": lines, "_first": F.try_element_at(lines, F.lit(1)), "_last": F.try_element_at(lines, F.lit(-1))})
    good, bad = parted(own, F.contains("_first", F.lit(" in ")) & F.contains("text", F.lit(middle)) & F.col("_last").startswith("Response: "), kind)
    ship = named(F.substring_index("_first", " in ", 1))
    return good.withColumns({"ship_name": ship[0], "ship_code": ship[1], "sector_name": F.expr("substr(_first, instr(_first, ' in ') + 4)"), "response": F.expr("substr(_last, 11)")}), bad


def _first_sector(sectors: DataFrame) -> DataFrame:
    return sectors.groupBy(F.col("name").alias("sector_name")).agg(F.min("sector").alias("sector"))


def pirates(log: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Harassed ships with their sectors (sector, name; the least of a name), pirates and responses."""
    good, bad = _stopped(log, PIRATES, "pirates", "Accosted by ")
    line = F.try_element_at("_l", F.lit(3))
    who = named(F.regexp_replace(line, "\\.$", ""))
    faction = F.nullif(F.regexp_extract(line, "^([A-Z]{3}) ", 1), F.lit(""))
    good = good.withColumns({"pirate_faction": faction, "pirate_name": F.regexp_replace(who[0], "^[A-Z]{3} ", ""), "pirate_code": who[1]})
    return good.join(_first_sector(sectors), "sector_name", "left").select("time", "ship_name", "ship_code", "sector", "sector_name", "pirate_name", "pirate_code", "pirate_faction", "response"), bad


def police(log: DataFrame, sectors: DataFrame, factions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stopped ships with their sectors, the police's faction (short, of factions (name, short)) and responses."""
    good, bad = _stopped(log, POLICE, "police", " police to stop ")
    by = F.regexp_extract(F.try_element_at("_l", F.lit(2)), "^Ordered by (.+) police to stop ", 1)
    short = factions.select(F.col("name").alias("_faction"), F.col("short").alias("police_faction"))
    good = good.withColumn("_faction", by).join(short, "_faction", "left")
    return good.join(_first_sector(sectors), "sector_name", "left").select("time", "ship_name", "ship_code", "sector", "sector_name", "police_faction", "response"), bad


def report(unread: Sequence[DataFrame], samples: int = 3) -> DataFrame:
    """(kind, n, samples): how many entries of each kind weren't read, and the first distinct samples in order, cut to 220 characters."""
    every = reduce(DataFrame.unionByName, unread)
    per = every.groupBy("kind", F.substring("sample", 1, 220).alias("sample")).agg(F.count("*").alias("m"))
    first = Window.partitionBy("kind").orderBy("sample")  # Spark keeps so many rows of a kind in each task before the shuffle
    told = per.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= samples).groupBy("kind").agg(F.sort_array(F.collect_list("sample")).alias("samples"))
    return per.groupBy("kind").agg(F.sum("m").alias("n")).join(told, "kind")
