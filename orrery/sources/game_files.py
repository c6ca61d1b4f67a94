"""Reference rows from the nodes of game files (see patches): wares, recipes, capacities, connections of the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import empty_to_null, to_double


def attr(name: str, step: int = -1) -> Column:
    """An attribute of a node's step: -1 the node itself, -2 what holds it."""
    return empty_to_null(F.try_element_at(F.try_element_at("steps", F.lit(step))["attrs"], F.lit(name)))


def number(name: str, step: int = -1) -> Column:
    return to_double(attr(name, step))


def ends(*tags: str) -> Column:
    """Whether a node's last steps have these tags."""
    own = F.transform(F.slice("steps", -len(tags), len(tags)), lambda s: s["tag"])
    return (F.size("steps") >= len(tags)) & (F.when(F.size("steps") >= len(tags), own) == F.array(*map(F.lit, tags)))


def holder(n: int = 1) -> Column:
    """The number of the node n steps above, which tells apart those of one document."""
    return F.try_element_at("line", F.lit(-1 - n))


def last_of(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows (doc, place, ...) of one key the last: by document and place."""
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct("doc", "place")).alias("_v")).select(*key, "_v.*")


def wares(nodes: DataFrame) -> DataFrame:
    """(ware, name, transport, volume, tags, price_min, price_avg, price_max, doc): the last definition of each ware that stands right below the root, with its price band; warn is set where the band is upside down."""
    top = (F.size("steps") == 2) & (F.col("tag") == "ware") & attr("id").isNotNull()
    own = last_of(nodes.filter(top).select("doc", "place", attr("id").alias("ware"), F.element_at("line", -1).alias("_n"), attr("name").alias("name"), attr("transport").alias("transport"), number("volume").alias("volume"), attr("tags").alias("tags")), "ware")
    price = nodes.filter(ends("ware", "price") & (F.size("steps") == 3)).select("doc", holder().alias("_n"), "place", number("min").alias("price_min"), number("average").alias("price_avg"), number("max").alias("price_max"))
    price = price.groupBy("doc", "_n").agg(F.min_by(F.struct("price_min", "price_avg", "price_max"), "place").alias("p")).select("doc", "_n", "p.*")
    return own.join(price, ["doc", "_n"], "left").withColumn("warn", F.coalesce(F.col("price_min") > F.col("price_max"), F.lit(False))).drop("_n", "place")


def recipes(nodes: DataFrame) -> DataFrame:
    """(ware, method, time, amount, input_ware, input_amount, work_effect): a row for each input of a production of a ware, one without input where there is none; equal rows once."""
    made = nodes.filter(ends("ware", "production") & (F.size("steps") == 3)).select("doc", F.element_at("line", -1).alias("_n"), attr("id", -2).alias("ware"), F.coalesce(attr("method"), F.lit("default")).alias("method"), number("time").alias("time"), number("amount").alias("amount")).filter("ware IS NOT NULL")
    taken = nodes.filter(ends("production", "primary", "ware")).select("doc", holder(2).alias("_n"), attr("ware").alias("input_ware"), number("amount").alias("input_amount"))
    work = nodes.filter(ends("production", "effects", "effect") & (attr("type") == "work")).select("doc", holder(2).alias("_n"), "place", number("product").alias("product")).groupBy("doc", "_n").agg(F.min_by("product", "place").alias("work_effect"))
    return made.join(taken, ["doc", "_n"], "left").join(work, ["doc", "_n"], "left").drop("doc", "_n").distinct()


def capacities(nodes: DataFrame) -> DataFrame:
    """(macro, class, housing, workers, cargo_max, cargo_tags, units) of the macros that state any of these; a diff of a macro's file is in nodes by then, if the macro is known."""
    own = nodes.filter((F.col("tag") == "macro") & attr("name").isNotNull()).select("doc", "place", F.element_at("line", -1).alias("_n"), F.lower(attr("name")).alias("macro"), attr("class").alias("class"))
    kinds = {"workforce": {"housing": number("capacity"), "workers": number("max")}, "cargo": {"cargo_max": number("max"), "cargo_tags": attr("tags")}, "storage": {"units": number("unit")}}
    said = nodes.filter(F.col("tag").isin(*kinds) & (F.try_element_at("steps", F.lit(-2))["tag"] == "properties"))
    values = [F.max(F.when(F.col("tag") == tag, c)).alias(name) for tag, of in kinds.items() for name, c in of.items()]
    return last_of(own.join(said.groupBy("doc", holder(2).alias("_n")).agg(*values), ["doc", "_n"]).drop("_n"), "macro").drop("doc", "place")


def connections(nodes: DataFrame) -> DataFrame:
    """(doc, place, macro, kind, ref, name, path, target_ref, target_path, target_connection, x, z): connections of macros, what each leads to and where it lies; inner: those within another connection."""
    own = nodes.filter("tag = 'connection'").select("doc", "place", F.element_at("line", -1).alias("_n"), holder(2).alias("outer"), F.lower(attr("name", -3)).alias("macro"), attr("class", -3).alias("kind"), attr("ref").alias("ref"), F.lower(attr("name")).alias("name"), attr("path").alias("path"))
    to = nodes.filter(ends("connection", "macro")).select("doc", holder().alias("_n"), "place", F.struct(F.lower(attr("ref")).alias("target_ref"), attr("path").alias("target_path"), attr("connection").alias("target_connection")).alias("to")).groupBy("doc", "_n").agg(F.min_by("to", "place").alias("to"))
    at = nodes.filter(ends("connection", "offset", "position")).select("doc", holder(2).alias("_n"), F.coalesce(number("x"), F.lit(0.0)).alias("x"), F.coalesce(number("z"), F.lit(0.0)).alias("z"))
    return own.join(to, ["doc", "_n"], "left").join(at, ["doc", "_n"], "left").select("doc", "place", F.col("_n").alias("number"), "outer", "macro", "kind", "ref", "name", "path", "to.*", "x", "z")


# Classes of ships with their sizes, what modification wares begin with, and the tokens of a weapon's size.
SIZES = {"ship_xs": "XS", "ship_s": "S", "ship_m": "M", "ship_l": "L", "ship_xl": "XL"}
MOD, WEAPON_SIZES = "mod_", ("s", "m", "l", "xl")


def macros(nodes: DataFrame) -> DataFrame:
    """(doc, place, number, macro, class) of the macros that documents define."""
    return nodes.filter((F.col("tag") == "macro") & attr("name").isNotNull()).select("doc", "place", F.element_at("line", -1).alias("number"), F.lower(attr("name")).alias("macro"), attr("class").alias("class"))


def properties(nodes: DataFrame, fields: dict[str, tuple[str, Column]]) -> DataFrame:
    """(doc, number, fields): attributes of the properties of each macro, by tag."""
    said = nodes.filter((F.try_element_at("steps", F.lit(-2))["tag"] == "properties") & F.col("tag").isin(*{t for t, _ in fields.values()}))
    return said.groupBy("doc", holder(2).alias("number")).agg(*[F.max(F.when(F.col("tag") == tag, c)).alias(name) for name, (tag, c) in fields.items()])


def factions(nodes: DataFrame) -> DataFrame:
    """(faction, shortname, name, race, colour) of factions with a name; the colour by its reference, a mapping of that and what the mapping leads to."""
    byte = lambda c: F.bround(F.coalesce(number(c), F.lit(0.0))).cast("int")
    hue = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(byte(c).cast("long")), 2, "0")) for c in "rgb"])
    colours = last_of(nodes.filter((F.col("tag") == "color") & attr("id").isNotNull() & attr("r").isNotNull()).select("doc", "place", attr("id").alias("_to"), hue.alias("colour")), "_to").drop("doc", "place")
    mapped = last_of(nodes.filter((F.col("tag") == "mapping") & attr("id").isNotNull() & attr("ref").isNotNull()).select("doc", "place", attr("id").alias("_ref"), attr("ref").alias("_to")), "_ref").drop("doc", "place")
    own = last_of(nodes.filter((F.col("tag") == "faction") & attr("id").isNotNull() & attr("name").isNotNull()).select("doc", "place", F.element_at("line", -1).alias("number"), attr("id").alias("faction"), attr("shortname").alias("shortname"), attr("name").alias("name"), attr("primaryrace").alias("race")), "faction")
    ref = nodes.filter(ends("faction", "color")).groupBy("doc", holder().alias("number")).agg(F.min_by(attr("ref"), "place").alias("_ref"))
    return own.join(ref, ["doc", "number"], "left").join(mapped, "_ref", "left").join(colours, "_to", "left").select("faction", "shortname", "name", "race", "colour")


def map_names(nodes: DataFrame) -> DataFrame:
    """(macro, name, description) of the map's parts, the last of each."""
    own = nodes.filter(ends("dataset", "properties", "identification") & attr("macro", -3).isNotNull())
    return last_of(own.select("doc", "place", F.lower(attr("macro", -3)).alias("macro"), attr("name").alias("name"), attr("description").alias("description")), "macro").drop("doc", "place")


def products(nodes: DataFrame) -> DataFrame:
    """(macro, ware, method, scale, workers): what modules make, each ware and method once, as the first file has it.

    A production has queues that name a ware or items that do, or else a list of
    wares; a module without a production may have products, which scale a ware's
    processing.
    """
    method = F.coalesce(attr("method"), F.lit("default"))
    at = lambda n, rank: {"number": holder(n), "rank": F.lit(rank)}
    rows = lambda where, n, rank, ware, how, scale: nodes.filter(where).select("doc", "place", *[c.alias(k) for k, c in (at(n, rank) | {"ware": ware, "method": how, "scale": scale}).items()])
    one, wares_ = F.lit(1.0), attr("ware")
    queued = rows(ends("macro", "properties", "production", "queue") & wares_.isNotNull(), 3, 0, wares_, method, one).unionByName(rows(ends("macro", "properties", "production", "queue", "item") & wares_.isNotNull(), 4, 0, wares_, method, one))
    made = nodes.filter(ends("macro", "properties", "production")).select("doc", "place", holder(2).alias("number"), attr("wares").alias("_w"))
    listed = made.join(queued.select("doc", "number").distinct(), ["doc", "number"], "left_anti").select("doc", "place", "number", F.lit(1).alias("rank"), F.explode(F.filter(F.split("_w", r"\s+"), lambda x: x != "")).alias("ware"), F.lit("default").alias("method"), one.alias("scale"))
    processed = rows(ends("macro", "properties", "products", "ware") & wares_.isNotNull(), 3, 2, wares_, F.lit("processing"), F.coalesce(F.nullif(number("amount"), F.lit(0.0)), one)).join(made.select("doc", "number").distinct(), ["doc", "number"], "left_anti")
    every = queued.unionByName(listed).unionByName(processed).join(macros(nodes).select("doc", "number", "macro"), ["doc", "number"]).join(properties(nodes, {"workers": ("workforce", number("max"))}), ["doc", "number"], "left")
    return every.groupBy("macro", "ware", "method").agg(F.min_by(F.struct("scale", "workers"), F.struct("doc", "place")).alias("v")).select("macro", "ware", "method", "v.*")


def ships(nodes: DataFrame, storages: DataFrame) -> DataFrame:
    """(macro, name, size, race, purpose, hull, mass, cargo, cargo_tags, crew, drag): ships, the last of each macro.

    A ship has a cargo of its own or else that of the storage macros that its
    connections name: their sum, and all their tags in order.
    """
    own = last_of(macros(nodes).filter(F.col("class").isin(*SIZES)), "macro")
    said = properties(nodes, {"name": ("identification", attr("name")), "race": ("identification", attr("makerrace")), "purpose": ("purpose", attr("primary")), "hull": ("hull", number("max")), "mass": ("physics", number("mass")), "_own": ("cargo", F.coalesce(number("max"), F.lit(0.0))), "_own_tags": ("cargo", attr("tags")), "crew": ("people", number("capacity"))})
    drag = nodes.filter(ends("macro", "properties", "physics", "drag")).groupBy("doc", holder(3).alias("number")).agg(F.max(number("forward")).alias("drag"))
    stores = last_of(macros(storages).join(properties(storages, {"_max": ("cargo", F.coalesce(number("max"), F.lit(0.0))), "_tags": ("cargo", attr("tags"))}), ["doc", "number"]).filter("_max IS NOT NULL"), "macro").select(F.col("macro").alias("_store"), "_max", "_tags")
    linked = nodes.filter(ends("macro", "connections", "connection", "macro")).select("doc", holder(3).alias("number"), F.lower(attr("ref")).alias("_store")).join(stores, "_store")
    held = linked.groupBy("doc", "number").agg(F.sum("_max").alias("_held"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(F.coalesce("_tags", F.lit("")), r"\s+"), lambda x: x != ""))))), " ").alias("_held_tags"))  # the holds of a ship
    size = F.coalesce(*[F.when(F.col("class") == c, s) for c, s in SIZES.items()])
    rows = own.join(said, ["doc", "number"], "left").join(drag, ["doc", "number"], "left").join(held, ["doc", "number"], "left")
    return rows.select("macro", F.coalesce("name", "macro").alias("name"), size.alias("size"), "race", "purpose", "hull", "mass", F.coalesce("_own", "_held").alias("cargo"), F.when(F.col("_own").isNotNull(), F.col("_own_tags")).otherwise(F.nullif("_held_tags", F.lit(""))).alias("cargo_tags"), "crew", "drag")


def region_yields(nodes: DataFrame) -> DataFrame:
    """(level, ware, capacity, respawn_min) of regions."""
    own = nodes.filter(ends("yields", "yield", "ware"))
    return own.select(attr("id", -2).alias("level"), attr("id").alias("ware"), F.coalesce(number("yield"), F.lit(0.0)).alias("capacity"), F.coalesce(number("respawndelay"), F.lit(0.0)).alias("respawn_min"))


def gather_speeds(nodes: DataFrame) -> DataFrame:
    """(speed, factor, rating)."""
    return nodes.filter(ends("gatherspeeds", "gatherspeed")).select(attr("id").alias("speed"), F.coalesce(number("factor"), F.lit(1.0)).alias("factor"), F.coalesce(number("rating"), F.lit(0.0)).alias("rating"))


#: Properties of bullets: field (tag, attribute, what it is without). The format's names.
BULLET = {"speed": ("bullet", "speed", None), "lifetime": ("bullet", "lifetime", None), "range": ("bullet", "range", None), "chargetime": ("bullet", "chargetime", None), "amount": ("bullet", "amount", 1.0), "barrelamount": ("bullet", "barrelamount", 1.0), "heat": ("heat", "value", 0.0), "heat_initial": ("heat", "initial", 0.0), "reload_rate": ("reload", "rate", None), "reload_time": ("reload", "time", None), "ammo_clip": ("ammunition", "value", None), "ammo_reload": ("ammunition", "reload", None), "dmg": ("damage", "value", 0.0), "dmg_shield": ("damage", "shield", 0.0), "dmg_hull": ("damage", "hull", 0.0), "area_dmg": ("areadamage", "value", 0.0)}


def weapons(nodes: DataFrame, bullets: DataFrame) -> DataFrame:
    """(macro, class, size, bullet, overheat, coolrate, and the fields of BULLET): weapons with the bullets that they name; those without a known one are left out."""
    shots = last_of(macros(bullets).select("doc", "place", "number", F.col("macro").alias("bullet")), "bullet").join(properties(bullets, {k: (t, number(a)) for k, (t, a, _) in BULLET.items()}), ["doc", "number"], "left").drop("doc", "number", "place")
    shots = shots.fillna({k: v for k, (*_, v) in BULLET.items() if v is not None})
    own = last_of(macros(nodes), "macro").join(properties(nodes, {"bullet": ("bullet", F.lower(attr("class"))), "overheat": ("heat", number("overheat")), "coolrate": ("heat", number("coolrate"))}), ["doc", "number"])
    tokens = F.filter(F.split("macro", "_"), lambda x: x.isin(*WEAPON_SIZES))
    return own.join(shots, "bullet").select("macro", "class", F.coalesce(F.upper(F.get(tokens, F.lit(0))), F.lit("?")).alias("size"), "bullet", "overheat", "coolrate", *BULLET)


def equipment_mods(nodes: DataFrame) -> DataFrame:
    """(ware, stat, quality, min, max, chance, bonus_max, forced, bonuses): modifications of equipment, the last of each ware; bonuses: array of (stat, min, max, weight) in order. forced: all of them come, as the chance is sure and they are no more than may be."""
    one = F.lit(1.0)
    own = nodes.filter(F.coalesce(attr("ware").startswith(MOD), F.lit(False)) & attr("quality").isNotNull())
    own = last_of(own.select("doc", "place", F.element_at("line", -1).alias("number"), attr("ware").alias("ware"), F.col("tag").alias("stat"), number("quality").cast("int").alias("quality"), F.coalesce(number("min"), one).alias("min"), F.coalesce(number("max"), one).alias("max")), "ware")
    bonus = nodes.filter((F.col("tag") == "bonus")).groupBy("doc", holder().alias("number")).agg(F.max(F.coalesce(number("chance"), F.lit(0.0))).alias("chance"), F.max(F.coalesce(number("max"), F.lit(0.0)).cast("int")).alias("bonus_max"))
    parts = nodes.filter(F.try_element_at("steps", F.lit(-2))["tag"] == "bonus").groupBy("doc", holder(2).alias("number")).agg(F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("tag").alias("stat"), F.coalesce(number("min"), one).alias("min"), F.coalesce(number("max"), one).alias("max"), F.coalesce(number("weight"), one).alias("weight")).alias("b")))).alias("_parts"))  # those of one modification
    rows = own.join(bonus, ["doc", "number"], "left").join(parts, ["doc", "number"], "left").fillna(0.0, ["chance"]).fillna(0, ["bonus_max"])
    bonuses = F.coalesce(F.transform("_parts", lambda x: x["b"]), F.array().cast("array<struct<stat:string,min:double,max:double,weight:double>>"))
    rows = rows.withColumn("bonuses", bonuses)
    return rows.select("ware", "stat", "quality", "min", "max", "chance", "bonus_max", ((F.size("bonuses") > 0) & (F.col("chance") >= 1) & (F.size("bonuses") <= F.col("bonus_max"))).alias("forced"), "bonuses")


def mod_names(nodes: DataFrame) -> DataFrame:
    """(ware, name) of modifications' wares: the short name, or else what stands before a bracket in the long one, or the ware itself."""
    own = nodes.filter((F.col("tag") == "ware") & F.coalesce(attr("id").startswith(MOD), F.lit(False)))
    name = F.coalesce(F.nullif(F.trim(attr("shortname")), F.lit("")), F.nullif(F.trim(F.substring_index(attr("name"), " (", 1)), F.lit("")), attr("id"))
    return last_of(own.select("doc", "place", attr("id").alias("ware"), name.alias("name")), "ware").drop("doc", "place")


# Types of engines.
ENGINE_TYPES = ("allround", "travel", "combat")
BODY_SIZES = ("xs", *WEAPON_SIZES)


def inner_token(fits) -> Column:
    """The first word of a macro's name, by underscores, that fits; its first and last word don't count."""
    words = F.split("macro", "_")
    return F.get(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), fits), F.lit(0))


def engines(nodes: DataFrame) -> DataFrame:
    """(macro, size, type, mk, forward, reverse, boost_*, travel_*): engines with a thrust, the last of each macro; what isn't stated is zero, the mark one. Films of engines (documents with `video` in their name) are none."""
    zero = lambda tag, name: (tag, F.coalesce(number(name), F.lit(0.0)))
    fields = {"forward": zero("thrust", "forward"), "reverse": zero("thrust", "reverse")}
    fields |= {f"boost_{a}": zero("boost", a) for a in ("duration", "recharge", "thrust", "acceleration", "attack", "release")} | {f"travel_{a}": zero("travel", a) for a in ("charge", "thrust", "attack", "release")}
    own = macros(nodes.filter(~F.col("doc").cast("string").contains("video"))).filter("class = 'engine'").join(properties(nodes, fields), ["doc", "number"]).filter("forward IS NOT NULL")
    mark = F.substring(inner_token(lambda x: x.rlike("^mk[0-9]$")), 3, 1).cast("int")
    rest = [F.coalesce(f, F.lit(0.0)).alias(f) for f in fields]
    return last_of(own, "macro").select("macro", inner_token(lambda x: x.isin(*BODY_SIZES)).alias("size"), inner_token(lambda x: x.isin(*ENGINE_TYPES)).alias("type"), F.coalesce(mark, F.lit(1)).alias("mk"), *rest)


def thrusters(nodes: DataFrame) -> DataFrame:
    """(size, strafe, pitch, yaw, roll): of each size the first that documents have, in order."""
    axes = ("strafe", "pitch", "yaw", "roll")
    own = macros(nodes).join(properties(nodes, {a: ("thrust", F.coalesce(number(a), F.lit(0.0))) for a in axes}), ["doc", "number"]).filter("strafe IS NOT NULL").withColumn("size", inner_token(lambda x: x.isin(*BODY_SIZES)))
    return own.filter("size IS NOT NULL").groupBy("size").agg(F.min_by(F.struct(*axes), F.struct("doc", "place")).alias("v")).select("size", "v.*")


def bodies(nodes: DataFrame) -> DataFrame:
    """(macro, name, size, purpose, mass, inertia_*, drag_*): ships with a drag, the last of each macro; what isn't stated is one."""
    one = lambda name: F.coalesce(number(name), F.lit(1.0))
    said = properties(nodes, {"name": ("identification", attr("name")), "purpose": ("purpose", attr("primary")), "mass": ("physics", one("mass"))})
    axes = {"drag": ("forward", "reverse", "horizontal", "vertical", "pitch", "yaw", "roll"), "inertia": ("pitch", "yaw", "roll")}
    parts = nodes.filter(ends("macro", "properties", "physics", "drag") | ends("macro", "properties", "physics", "inertia"))
    values = parts.groupBy("doc", holder(3).alias("number")).agg(F.max(F.col("tag") == "drag").alias("_drags"), *[F.coalesce(F.max(F.when(F.col("tag") == tag, one(a))), F.lit(1.0)).alias(f"{tag}_{a}") for tag, of in axes.items() for a in of])
    own = macros(nodes).filter(F.col("class").startswith("ship_")).join(said, ["doc", "number"]).join(values.filter("_drags"), ["doc", "number"])
    return last_of(own, "macro").select("macro", F.coalesce("name", "macro").alias("name"), F.expr("substr(class, 6)").alias("size"), "purpose", "mass", *[f"{tag}_{a}" for tag in ("inertia", "drag") for a in axes[tag]])


def shields(nodes: DataFrame) -> DataFrame:
    """(macro, size, capacity, rate, delay): shields with a recharge, the last of each macro; what isn't stated is zero."""
    fields = {k: ("recharge", F.coalesce(number(a), F.lit(0.0))) for k, a in (("capacity", "max"), ("rate", "rate"), ("delay", "delay"))}
    own = macros(nodes).filter(F.col("class").startswith("shield")).join(properties(nodes, fields), ["doc", "number"]).filter("capacity IS NOT NULL")
    return last_of(own, "macro").select("macro", inner_token(lambda x: x.isin(*BODY_SIZES)).alias("size"), *fields)
