"""The world tables of a snapshot, as joins and sums of its records.

TABLES names each table's key and how it is made from the elements of one or more
files. Where a document repeats a key the last row counts, unless the table says
otherwise; a table without a key keeps all its rows. Every row carries its file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import lower_or_null, to_double
from orrery.operators.windows import keep_last

from . import snapshot_xml as X


@dataclass(frozen=True)
class Table:
    key: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]


def lowered(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: lower_or_null(c) for c in columns})


def plain(name: str, *lower: str, where: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """A record as it is, with some columns in lower case, of the rows that have all of `where`."""
    return lambda elems: lowered(X.records(elems, name), *lower).dropna(subset=list(where)) if where else lowered(X.records(elems, name), *lower)


def placed(elems: DataFrame) -> DataFrame:
    """Components of the universe's tree: those without a connection lie outside it. Stations, build storages and ships without an owner have their offsets from the sector."""
    own = X.records(elems, "component").filter("connection IS NOT NULL")
    at = own.filter(F.col("class").isin("station", "buildstorage") | (F.col("class").startswith("ship_") & F.col("owner").isNull())).select("file", "ord").join(X.positions(elems), ["file", "ord"])
    return lowered(own.drop("connection"), "cluster_macro", "sector_macro").join(at, ["file", "ord"], "left")


def summed(df: DataFrame, *key: str) -> DataFrame:
    return df.dropna(subset=list(key)).groupBy("file", *key).agg(F.min("ord").alias("ord"), F.sum("amount").alias("amount"))


def plan_entries(elems: DataFrame) -> DataFrame:
    """Entries of build plans. A host lists an entry several times, of which the first counts; one without an id counts as built, another if a finished component of its host names it."""
    entries = X.records(elems, "plan_entry").drop("elem")
    named, rest = entries.filter("entry_id IS NOT NULL"), entries.filter("entry_id IS NULL")
    first = named.groupBy("file", F.col("host_id"), "entry_id").agg(F.min_by(F.struct("ord", "index", "macro"), "ord").alias("e")).select("file", "e.ord", "host_id", "e.index", "e.macro", "entry_id")
    built = X.records(elems, "built_ref").select("file", F.col("host").alias("host_id"), F.col("entry").alias("entry_id"), F.lit(1).alias("built")).distinct()
    return first.join(built, ["file", "host_id", "entry_id"], "left").fillna(0, ["built"]).unionByName(rest.withColumn("built", F.lit(1)))


def production(elems: DataFrame) -> DataFrame:
    """How many production modules of a host are alike."""
    own = X.records(elems, "module_production").withColumnRenamed("ord", "_ord")
    comp = elems.filter("tag = 'production'").select("file", F.col("ord").alias("elem"), X.last()["ord"].alias("comp"))
    ware = X.records(elems, "module_ware").groupBy("file", "comp").agg(F.min_by("ware", "ord").alias("ware"))
    good = X.records(elems, "module_efficiency").groupBy("file", "elem").agg(F.min_by("efficiency", "ord").alias("efficiency"))
    rows = own.join(comp, ["file", "elem"]).join(ware, ["file", "comp"], "left").join(good, ["file", "elem"], "left")
    return rows.groupBy("file", F.col("host").alias("object_id"), lower_or_null("macro").alias("macro"), "ware", "efficiency", "state").agg(F.min("_ord").alias("ord"), F.count("*").alias("n_modules"))


def build_tasks(elems: DataFrame) -> DataFrame:
    """Tasks and their progress with class, macro and code of the target, which may lie outside the tree. Rows without a host or a task are left out."""
    targets = X.records(elems, "component").groupBy("file", F.col("id").alias("target_id")).agg(F.max_by(F.struct(F.col("class").alias("target_class"), F.col("macro").alias("target_macro"), F.col("code").alias("target_code")), "ord").alias("t"))
    rows = lowered(X.records(elems, "build_task"), "faction", "method").dropna(subset=["host_id", "task_id"])
    return rows.join(targets, ["file", "target_id"], "left").select(*rows.columns, "t.*")


def skills(elems: DataFrame) -> DataFrame:
    return X.records(elems, "npc_skill").select("file", "ord", "npc_id", F.explode("skills").alias("skill", "_v")).withColumn("value", to_double("_v")).drop("_v")


def inside(elems: DataFrame, name: str) -> DataFrame:
    """For the components of a record, those around each element that lie in one: (file, ord of the element, id of that component, tag, class and attributes)."""
    own = X.records(elems, name).select("file", F.col("ord").alias("comp"), "id")
    each = elems.select("file", "ord", "tag", "attrs", "path", F.explode("comps").alias("c")).select("file", "ord", "tag", "attrs", "path", F.col("c.ord").alias("comp"))
    return each.join(own, ["file", "comp"]).filter(F.col("comp") <= F.col("ord"))


def vaults(elems: DataFrame) -> DataFrame:
    """Data vaults with what is left in them: containers and the blueprints that they hold, in order."""
    own = X.records(elems, "datavault").join(X.positions(elems), ["file", "ord"], "left")
    around = inside(elems, "datavault").filter(F.col("comp") < F.col("ord"))
    held = F.when((F.col("tag") == "component") & (X.a("class").isin("collectablewares", "collectableblueprints") | X.a("blueprints").isNotNull()), 1)
    open_ = F.when((F.col("tag") == "unlock") & (X.a("state") == "unlocked"), 1)
    prints = F.when(held == 1, F.struct("ord", X.a("blueprints").alias("b")))
    left = around.groupBy("file", "id").agg(F.max(open_).alias("unlocked"), F.count(held).alias("loot"), F.array_sort(F.collect_list(prints)).alias("_b"))  # the containers of one vault
    texts = F.nullif(F.array_join(F.transform(F.filter("_b", lambda x: x["b"].isNotNull()), lambda x: x["b"]), ","), F.lit(""))
    left = left.select("file", "id", "unlocked", "loot", texts.alias("blueprints"))
    return lowered(own.join(left, ["file", "id"], "left").fillna(0, ["unlocked", "loot"]), "sector_macro").withColumnRenamed("id", "object_id")


def engines(elems: DataFrame) -> DataFrame:
    """Engines of the player's ships, alike ones counted."""
    ships = X.records(elems, "component").filter(F.col("class").startswith("ship_") & (F.col("owner") == "player")).select("file", F.col("id").alias("object_id")).distinct()
    return X.records(elems, "ship_engine").join(ships, ["file", "object_id"], "left_semi").groupBy("file", "object_id", "macro").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))


def factions(elems: DataFrame) -> DataFrame:
    """Treasury (credits) and preferred build method of the factions that have either."""
    child = lambda tag, c, name: elems.filter(F.col("path").rlike(f"factions/faction/{tag}$")).select("file", F.col("parent").alias("elem"), "ord", c.alias(name))
    named = X.records(elems, "faction").select("file", "elem", F.lower("faction").alias("faction"))
    money = child("account", X.cents(X.a("amount")), "account_cr").join(named, ["file", "elem"]).groupBy("file", "faction").agg(F.max_by("account_cr", "ord").alias("account_cr"))
    rule = child("buildrules", lower_or_null(X.a("method")), "build_method").join(named, ["file", "elem"]).groupBy("file", "faction").agg(F.max_by("build_method", "ord").alias("build_method"))
    return money.join(rule, ["file", "faction"], "full").withColumn("ord", F.lit(0).cast("long"))


def relations(elems: DataFrame) -> DataFrame:
    return lowered(X.faction_relations(elems), "faction", "other").withColumn("ord", F.lit(0).cast("long"))


def numbered(df: DataFrame) -> DataFrame:
    return df if "ord" in df.columns else df.withColumn("ord", F.lit(0).cast("long"))


TABLES: dict[str, Table] = {
    "component": Table(("id",), placed),
    "fleet_edge": Table(("follower",), lambda e: numbered(X.fleet_edges(e).drop("conflict"))),
    "build_entry": Table((), plan_entries),
    "module_production": Table((), production),
    "build_task": Table(("host_id", "comp_id", "kind", "task_id"), build_tasks),
    "workforce": Table((), lambda e: summed(X.records(e, "workforce"), "station_id", "race")),
    "npc": Table(("id",), plain("npc")),
    "npc_skill": Table(("npc_id", "skill"), skills),
    "post": Table((), plain("post")),
    "people": Table((), lambda e: numbered(X.crew(e))),
    "cargo": Table((), lambda e: summed(X.records(e, "cargo"), "object_id", "ware")),
    "trade_offer": Table((), plain("trade_offer")),
    "build_resource": Table((), plain("build_resource")),
    "ship_order": Table((), plain("ship_order")),
    "datavault": Table(("object_id",), vaults),
    "faction_relation": Table((), relations),
    "faction_meta": Table((), factions),
    "player_subscription": Table(("object_id",), plain("player_subscription")),
    "build_method": Table(("object_id",), plain("station_build_method", "method", where=["object_id"])),
    "station_supply": Table(("object_id", "kind", "ware"), plain("station_supply", "ware", where=["object_id", "ware"])),
    "price_setting": Table(("object_id", "kind", "ware"), plain("price_setting", "ware", where=["object_id", "ware"])),
    "ware_limit": Table(("object_id", "kind", "ware"), plain("ware_limit", "ware", where=["object_id", "ware"])),
    "build_price_factor": Table(("object_id",), plain("build_price_factor")),
    "player_scan": Table(("object_id",), plain("player_scan")),
    "player_stat": Table(("id",), plain("player_stat", where=["id"])),
    "station_trade_setting": Table(("object_id", "setting", "ware"), plain("trade_setting")),
    "trade_pending": Table((), lambda e: numbered(lowered(X.pending_trades(e), "ware"))),
    "ship_engine": Table((), engines),
}


def header(elems: DataFrame) -> DataFrame:
    """(file, guid, game_version, game_time, save_date, modified, player_name, player_money_cr) of each document."""
    info = X.records(elems.filter(F.col("tag").isin("game", "save", "player")), "info")
    of = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    return info.groupBy("file").agg(
        of("game", "guid").alias("guid"), of("game", "version").alias("game_version"), of("game", "game_time").alias("game_time"), of("save", "save_date").alias("save_date"),
        F.coalesce(of("game", "modified").try_cast("int"), F.lit(0)).alias("modified"), of("player", "name").alias("player_name"), (of("player", "money") / 100).alias("player_money_cr"),
    )


def kept(elems: DataFrame, path: str) -> DataFrame:
    """elems, parsed once and written to a folder: each table then reads the columns and tags that it needs."""
    elems.write.mode("overwrite").parquet(path)
    return elems.sparkSession.read.schema(elems.schema).parquet(path)


def world(elems: DataFrame, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the elements of one or more files, each with its file: of rows of one key the last, without its place in the document."""
    out = {}
    for name in names or TABLES:
        rows = TABLES[name].build(elems)
        out[name] = (keep_last(rows, ["file", *TABLES[name].key], ["ord"]) if TABLES[name].key else rows).drop("ord")
    return out


