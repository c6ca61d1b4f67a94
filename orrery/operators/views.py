"""The read layer: views over the world tables, as functions of a mapping of named frames.

World tables carry save_id; `save` has a row for each snapshot (save_id,
game_time). A view looks at the current snapshot, that of the greatest id, and
names come from the reference tables sector (macro, name), faction (id,
shortname) and ware (id, name, volume). Unknown ids never drop a row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Frames = Mapping[str, DataFrame]


def current_save(frames: Frames) -> DataFrame:
    """(save_id, game_time): a row."""
    return frames["save"].agg(F.max("save_id").alias("save_id"), F.max_by("game_time", "save_id").alias("game_time"))


def current(frames: Frames, name: str) -> DataFrame:
    """A world table's rows of the current snapshot, without its id."""
    return frames[name].join(F.broadcast(current_save(frames).select("save_id")), "save_id", "left_semi").drop("save_id")  # one row


def labelled(df: DataFrame, others: DataFrame, key: str, prefix: str, names: Mapping[str, str], by: str = "id") -> DataFrame:
    """df with columns of others whose `by` is df's key, called prefix_<name>; null where there is none."""
    own = others.select(F.col(by).alias(f"_{prefix}"), *[F.col(c).alias(f"{prefix}_{n}") for c, n in names.items()])
    return df.join(own, F.col(key) == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")


def with_sector(frames: Frames, df: DataFrame) -> DataFrame:
    return labelled(df, frames["sector"], "sector_macro", "sector", {"name": "name"}, "macro")


def with_ware(frames: Frames, df: DataFrame) -> DataFrame:
    return labelled(df, frames["ware"], "ware", "ware", {"name": "name"})


def universe(frames: Frames) -> DataFrame:
    """Components with the names of their sectors and the short names of their owners, and what each is called; models (macro, model) are those of ships."""
    named = labelled(with_sector(frames, current(frames, "component")), frames["faction"], "owner", "owner", {"shortname": "code"})
    named = labelled(named, frames["model"], "macro", "ship", {"model": "model"}, "macro")
    return named.withColumn("display_name", display_name(F.col("name"), F.col("ship_model"), F.col("owner_code"), F.col("basename"))).drop("ship_model")


def stock_delta(flow: DataFrame) -> DataFrame:
    """The stock flow by its former names."""
    return flow.withColumnsRenamed({"inflow": "dv", "outflow": "dv_neg"})


def entity_life(frames: Frames) -> DataFrame:
    """Entities with their observed span (up to now, while they live), whether they live, and where they are."""
    now = F.broadcast(current_save(frames).select(F.col("game_time").alias("_now")))
    here = current(frames, "component").filter("entity_id IS NOT NULL").select("entity_id", F.col("id").alias("component_id"), "sector_macro")
    span = F.coalesce("gone_time", "_now") - F.col("first_seen")
    return frames["entity"].join(now, F.lit(True), "left").withColumns({"observed_span_s": span, "alive": F.col("gone_time").isNull()}).drop("_now").join(here, "entity_id", "left")


def station(frames: Frames) -> DataFrame:
    """Stations with their sector, built modules (0 where there are none), workers and the volume of their cargo (null where there are none)."""
    own = with_sector(frames, current(frames, "component").filter("class = 'station'"))
    built = current(frames, "build_entry").filter("built = 1").groupBy(F.col("host_id").alias("id")).agg(F.count("*").alias("modules_built"))
    workers = current(frames, "workforce").groupBy(F.col("station_id").alias("id")).agg(F.sum("amount").alias("workforce"))
    volume = frames["ware"].select(F.col("id").alias("ware"), "volume")
    cargo = current(frames, "cargo").join(volume, "ware", "left").groupBy(F.col("object_id").alias("id")).agg(F.sum(F.col("amount") * F.coalesce("volume", F.lit(0.0))).alias("cargo_volume_m3"))
    return own.join(built, "id", "left").fillna(0, ["modules_built"]).join(workers, "id", "left").join(cargo, "id", "left")


def player_fleet(frames: Frames) -> DataFrame:
    """(follower_id, follower_entity, commander_id, commander_entity) of fleet edges whose ends are both the player's."""
    own = current(frames, "component").filter("owner = 'player'")
    out = current(frames, "fleet_edge").select(F.col("follower").alias("follower_id"), F.col("leader").alias("commander_id"))
    for end in ("follower", "commander"):
        out = out.join(own.select(F.col("id").alias(f"{end}_id"), F.col("entity_id").alias(f"{end}_entity")), f"{end}_id")
    return out.select("follower_id", "follower_entity", "commander_id", "commander_entity")


def build_method(frames: Frames) -> DataFrame:
    """(object_id, owner, method, source): the method of a station or build storage, its own or else its faction's; without either there is no row."""
    own = current(frames, "component").filter(F.col("class").isin("station", "buildstorage")).select(F.col("id").alias("object_id"), "owner")
    set_ = current(frames, "build_method").select("object_id", F.col("method").alias("_own"))
    rule = current(frames, "faction_meta").select(F.col("faction").alias("owner"), F.col("build_method").alias("_rule"))
    out = own.join(set_, "object_id", "left").join(rule, "owner", "left").withColumn("method", F.coalesce("_own", "_rule")).filter("method IS NOT NULL")
    return out.select("object_id", "owner", "method", F.when(F.col("_own").isNotNull(), "station").otherwise("faction").alias("source"))


def build_task(frames: Frames) -> DataFrame:
    """Build orders with their hosts, what they are for, and the progress of those at work: a row for each component that works on one."""
    rows, parts = current(frames, "build_task"), current(frames, "component")
    tasks = rows.filter("kind = 'task'").select("host_id", "task_id", "ctx", "type", "target_id", "target_class", "target_macro", "target_code", "builder", "faction", "time", "flags")
    tasks = labelled(tasks, parts, "host_id", "host", {c: c for c in ("code", "name", "class", "owner")})
    tasks = labelled(tasks, parts.select(F.col("id").alias("_id"), "name", "spawntime"), "target_id", "target", {"name": "name", "spawntime": "spawntime"}, "_id")
    work = rows.filter("kind = 'progress'").select("host_id", "task_id", "state", "step", "steps", "method", "sequence_index", "start_time", "end_time")
    return tasks.join(work, ["host_id", "task_id"], "left")


def build_storage_station(frames: Frames) -> DataFrame:
    """Build storages with the stations that their expansions are for, each pair once."""
    parts = current(frames, "component")
    rows = current(frames, "build_task").filter("kind = 'task' AND type = 'expand' AND target_id IS NOT NULL")
    pairs = rows.groupBy(F.col("host_id").alias("storage_id"), F.col("target_id").alias("station_id")).agg(F.min("target_macro").alias("station_macro"), F.min("ctx").alias("ctx"), F.min("time").alias("time"), F.count("*").alias("n_tasks"))
    pairs = labelled(pairs, parts, "storage_id", "storage", {"code": "code", "owner": "owner"}).withColumnRenamed("storage_owner", "owner")
    return labelled(pairs, parts, "station_id", "station", {"code": "code", "name": "name", "sector_macro": "sector"}).withColumnRenamed("station_sector", "sector_macro")


def on_station(frames: Frames, df: DataFrame, key: str, **more: str) -> DataFrame:
    """df with code and name of the station that key names, and any further columns of it (name there: name here)."""
    named = labelled(df, current(frames, "component"), key, "station", {"code": "code", "name": "name"} | {c: f"_{c}" for c in more})
    return named.withColumnsRenamed({f"station__{c}": to for c, to in more.items()})


def station_supply(frames: Frames) -> DataFrame:
    """Supplies that stations hold or ask for, with names."""
    return with_ware(frames, on_station(frames, current(frames, "station_supply"), "object_id", owner="owner"))


def supply_position(frames: Frames) -> DataFrame:
    """What a station holds of a ware for itself, and has on order by offers flagged so; their sum is the least that it wants."""
    held = current(frames, "station_supply").filter("kind = 'ware'").groupBy("object_id", "ware").agg(F.sum("amount").alias("held"))
    asked = current(frames, "trade_offer").filter((F.col("side") == "buy") & F.col("flags").ilike("%supplies%")).groupBy("object_id", "ware").agg(F.sum(F.coalesce("desired", "amount")).alias("on_order"))
    both = held.join(asked, ["object_id", "ware"], "full").fillna(0, ["held", "on_order"]).withColumn("allocation", F.col("held") + F.col("on_order"))
    return with_ware(frames, on_station(frames, both, "object_id", owner="owner"))


def trade_pending(frames: Frames) -> DataFrame:
    """Trades that are agreed and under way, with the codes and factions of their parties."""
    parts, out = current(frames, "component"), with_ware(frames, current(frames, "trade_pending"))
    for end in ("buyer", "seller"):
        out = labelled(out, parts, f"{end}_id", end, {"code": "code", "owner": "faction"})
    return labelled(out, parts, "ship_id", "ship", {"code": "code"})


def built_module(frames: Frames) -> DataFrame:
    return current(frames, "build_entry").filter("built = 1")


#: The skills of crews.
SKILLS = ("piloting", "engineering", "boarding", "management", "morale")


def npc(frames: Frames) -> DataFrame:
    """People with a column for each skill."""
    most = [F.max(F.when(F.col("skill") == s, F.col("value"))).alias(s) for s in SKILLS]
    return current(frames, "npc").join(current(frames, "npc_skill").groupBy(F.col("npc_id").alias("id")).agg(*most), "id", "left")


def station_storage(frames: Frames) -> DataFrame:
    """The storage model's rows with the names of stations, sectors and wares."""
    named = on_station(frames, current(frames, "station_storage"), "station_id", sector_macro="sector_macro")
    return with_ware(frames, with_sector(frames, named)).drop("sector_macro")


def station_munition(frames: Frames) -> DataFrame:
    named = on_station(frames, current(frames, "station_munition"), "station_id", sector_macro="sector_macro", owner="owner")
    return with_sector(frames, named).drop("sector_macro")


def station_drones(frames: Frames) -> DataFrame:
    return station_munition(frames).filter("is_unit = 1")


def display_name(name: Column, model: Column, short: Column, base: Column) -> Column:
    """What a thing is called: by its name, its model, or its owner's short name and what it is."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(model, F.lit("")), F.concat(short, F.lit(" "), F.coalesce(base, F.lit("Station"))))
