"""The empire's stations, ships and people as its pages show them, and its sales and purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import empty_to_null

from .chronicle import PLAYER

# Mass and hull of a module, roles that are crew, posts of stations and ships with what they are called.
HULL, DENSITY = 250_000.0, 300.0
CREW = ("service", "marine")
STATION_POSTS = {"manager": "manager (station)", "engineer": "engineer (station)", "shiptrader": "shiptrader (station)"}
SHIP_POSTS = {"aipilot": "pilot (ship)", "engineer": "engineer (ship)"}


def station_types(objects: DataFrame, modules: DataFrame, makes: DataFrame, wares: DataFrame) -> DataFrame:
    """(id, type) of objects (id, class, basename): its base name, or else what its modules (id, macro, ord) make of it.

    Modules that build ships make it a Shipyard, where they build large ones, or a
    Wharf, others that build an Equipment Dock; else it is the factory of the ware
    (makes: macro, ware, ord, the first of a macro counts; wares: ware, name) that most
    of its modules make, of equally many that of the first module. Anything else is
    a Station, and a build storage a Build plot. Modules are counted by macro before
    they move.
    """
    macro = F.col("macro")
    builds = macro.contains("buildmodule")
    ships = builds & macro.contains("_ships_")
    large = ships & (macro.contains("_l_") | macro.contains("_xl_"))
    yards = modules.filter(builds).groupBy("id").agg(F.when(F.max(large), "Shipyard").when(F.max(ships), "Wharf").otherwise("Equipment Dock").alias("_yard"))
    product = makes.filter("ware <> ''").groupBy("macro").agg(F.min_by("ware", "ord").alias("ware"))
    made = modules.groupBy("id", "macro").agg(F.count("*").alias("_n"), F.min("ord").alias("_first")).join(product, "macro").groupBy("id", "ware").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    most = made.groupBy("id").agg(F.max_by("ware", F.struct("_n", -F.col("_first"))).alias("ware")).join(wares.groupBy("ware").agg(F.min("name").alias("_ware_name")), "ware", "left")
    factory = most.select("id", F.concat(F.coalesce(empty_to_null("_ware_name"), "ware"), F.lit(" Factory")).alias("_factory"))
    kind = F.when(F.col("class") == "buildstorage", "Build plot").otherwise(F.coalesce(empty_to_null("basename"), "_yard", "_factory", F.lit("Station")))
    return objects.select("id", "class", "basename").join(yards, "id", "left").join(factory, "id", "left").select("id", kind.alias("type"))


def masses(plans: DataFrame) -> DataFrame:
    """(id, modules, hull, mass) estimated of stations by the greatest index of their plans (id, index)."""
    most = plans.groupBy("id").agg(F.max("index").alias("modules"))
    return most.withColumn("hull", F.col("modules") * HULL).withColumn("mass", F.col("hull") / DENSITY)


def held_posts(posts: DataFrame, names: list[str]) -> DataFrame:
    """(object, a column a post) of posts (object, post, person): of several persons the least."""
    return posts.groupBy("object").agg(*[F.min(F.when(F.col("post") == n, F.col("person"))).alias(n) for n in names])


def stations(owned: DataFrame, posts: DataFrame, rollups: DataFrame) -> DataFrame:
    """The stations of owned (id, class, ...) with their posts and the rollups of views.station() (id, entity_id, sector_name, modules_built, workforce, cargo_volume_m3)."""
    held = held_posts(posts, list(STATION_POSTS))
    return owned.filter("class = 'station'").join(held.select(F.col("object").alias("id"), *[F.col(p).alias(f"{p}_id") for p in STATION_POSTS]), "id", "left").join(rollups, "id", "left")


def ships(owned: DataFrame, models: DataFrame, people: DataFrame, posts: DataFrame, persons: DataFrame) -> DataFrame:
    """(id, code, name, macro, size, model, crew, crew_most, aipilot, engineer, pilot_name, pilot_skill) of owned (id, class, code, name, macro) that are no stations.

    A ship without a name has its model's (models: macro, model, crew), or else its
    macro. crew counts service crew and marines (people: object, role, count), nobody
    known being none. persons: id, name, piloting.
    """
    aboard = people.filter(F.col("role").isin(*CREW)).groupBy(F.col("object").alias("id")).agg(F.sum("count").alias("crew"))
    known = models.groupBy("macro").agg(F.max_by("model", F.col("ord")).alias("model"), F.max_by("crew", F.col("ord")).alias("crew_most"))
    held = held_posts(posts, list(SHIP_POSTS)).withColumnRenamed("object", "id")
    pilots = persons.groupBy(F.col("id").alias("aipilot")).agg(F.min(F.struct("name", "piloting")).alias("_p"))
    rows = owned.filter("class <> 'station'").join(known, "macro", "left").join(aboard, "id", "left").join(held, "id", "left").join(pilots, "aipilot", "left")
    return rows.select("id", "code", F.coalesce(empty_to_null("name"), "model", "macro").alias("name"), "macro", F.upper(F.replace("class", F.lit("ship_"), F.lit(""))).alias("size"), "model", F.coalesce("crew", F.lit(0)).alias("crew"), "crew_most", "aipilot", "engineer", F.col("_p.name").alias("pilot_name"), F.col("_p.piloting").alias("pilot_skill"))


def roles(persons: DataFrame, own_ships: DataFrame, own_stations: DataFrame) -> DataFrame:
    """persons (id, role, ...) with the role of the post that they hold on own ships() or stations(); of several the last in the order pilot, engineer of a ship, manager, engineer, trader of a station. Others keep theirs."""
    columns = [(own_ships, SHIP_POSTS), (own_stations, {f"{p}_id": label for p, label in STATION_POSTS.items()})]
    held = None
    for first, (source, names) in zip((0, len(SHIP_POSTS)), columns):
        of = F.array(*[F.struct(F.col(c).alias("id"), F.lit(first + k).alias("k"), F.lit(label).alias("_role")) for k, (c, label) in enumerate(names.items())])
        part = source.select(F.explode(of).alias("x")).select("x.*").filter("id IS NOT NULL")
        held = part if held is None else held.unionByName(part)
    best = held.groupBy("id").agg(F.max_by("_role", "k").alias("_role"))
    return persons.join(best, "id", "left").withColumn("role", F.coalesce("_role", "role")).drop("_role")


def sales(trades: DataFrame, services: DataFrame) -> DataFrame:
    """(t, money, amount, ware, seller_name, seller_code, buyer_faction, buyer_name, buyer_code) of trades of the player with others, and services of the player's yards in the same columns."""
    columns = ("t", "money", "amount", "ware", "seller_name", "seller_code", "buyer_faction", "buyer_name", "buyer_code")
    sold = trades.filter(F.col("seller_faction").eqNullSafe(PLAYER) & ~F.col("buyer_faction").eqNullSafe(PLAYER))
    return sold.select(*columns).unionByName(services.select(*columns))


def buys(trades: DataFrame) -> DataFrame:
    """(t, money, amount, ware, buyer_name, buyer_code, seller_faction, seller_name, seller_code) of trades of others with the player, money being spent."""
    bought = trades.filter(~F.col("seller_faction").eqNullSafe(PLAYER) & F.col("buyer_faction").eqNullSafe(PLAYER))
    return bought.select("t", (-F.col("money")).alias("money"), "amount", "ware", "buyer_name", "buyer_code", "seller_faction", "seller_name", "seller_code")


def clock(log: DataFrame, game_time: float) -> DataFrame:
    """(now, logged_hours), a row: the time of the last log entry (t), or of the game without one, and the hours that the log covers."""
    ends = log.agg(F.max("t").alias("_last"), F.min("t").alias("_first"))
    return ends.select(F.coalesce("_last", F.lit(float(game_time))).alias("now"), F.coalesce((F.col("_last") - F.col("_first")) / 3600, F.lit(0.0)).alias("logged_hours"))
