"""Queries of the empire's stations, ships, people, sales and purchases over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import empire as E

from .relational import query, r
from .roles import TRADES_SQL, seconds, table, trades
from .views import END98


def text(name, c):
    return F.concat(F.lit(name), c.cast("string"))


@query("""WITH o AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'buildstorage' ELSE 'station' END AS class, CASE WHEN s_suppkey % 4 = 0 THEN 'Base ' || s_suppkey ELSE '' END AS basename FROM supplier),
 m AS (SELECT l_suppkey AS id, CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 1 THEN 'buildmodule' || CASE l_suppkey % 3 WHEN 0 THEN '_ships_l_x' WHEN 1 THEN '_ships_m_x' ELSE '_equip_l_x' END ELSE 'prod' || l_partkey % 40 END AS macro, l_orderkey * 8 + l_linenumber AS ord FROM lineitem WHERE l_suppkey % 7 <> 0),
 y AS (SELECT id, CASE WHEN bool_or(contains(macro, '_ships_l_')) THEN 'Shipyard' WHEN bool_or(contains(macro, '_ships_')) THEN 'Wharf' ELSE 'Equipment Dock' END AS yard FROM m WHERE contains(macro, 'buildmodule') GROUP BY id),
 p AS (SELECT id, 'w' || k % 12 AS ware, count(*) AS n, min(ord) AS f FROM (SELECT id, ord, macro[5:]::INT AS k FROM m WHERE macro[:4] = 'prod') WHERE k % 10 <> 3 GROUP BY ALL), b AS (SELECT id, arg_max(ware, (n, -f)) AS ware FROM p GROUP BY id)
 SELECT id, CASE WHEN class = 'buildstorage' THEN 'Build plot' ELSE coalesce(nullif(basename, ''), yard, CASE WHEN ware[2:]::INT % 3 = 0 THEN ware ELSE 'Name ' || ware END || ' Factory', 'Station') END AS type FROM o LEFT JOIN y USING (id) LEFT JOIN b USING (id)""")
def dom01_station_types(spark, sf_dir):
    s, k = F.col("l_suppkey"), F.col("s_suppkey")
    objects = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 9 == 0, "buildstorage").otherwise("station").alias("class"), F.when(k % 4 == 0, text("Base ", k)).otherwise("").alias("basename"))
    yard = F.when(s % 3 == 0, "buildmodule_ships_l_x").when(s % 3 == 1, "buildmodule_ships_m_x").otherwise("buildmodule_equip_l_x")
    modules = table(spark, sf_dir, "lineitem").filter(s % 7 != 0).select(s.alias("id"), F.when((s % 5 == 0) & (F.col("l_linenumber") == 1), yard).otherwise(text("prod", F.col("l_partkey") % 40)).alias("macro"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    w = F.col("p_partkey") % 40
    part = table(spark, sf_dir, "part")
    makes = part.select(text("prod", w).alias("macro"), F.when(w % 10 != 3, text("w", w % 12)).otherwise("").alias("ware"), F.col("p_partkey").alias("ord"))
    wares = part.filter(w % 12 % 3 != 0).select(text("w", w % 12).alias("ware"), text("Name w", w % 12).alias("name")).distinct()
    return E.station_types(objects, modules, makes, wares)


@query("SELECT l_suppkey AS id, max(l_linenumber) AS modules, max(l_linenumber) * 250000.0::DOUBLE AS hull, ROUND(max(l_linenumber) * 250000.0::DOUBLE / 300, 4) AS mass FROM lineitem GROUP BY l_suppkey")
def dom06_masses(spark, sf_dir):
    return E.masses(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("index"))).withColumn("mass", r("mass"))


FLEET_SQL = """own AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'station' WHEN 1 THEN 'ship_s' WHEN 2 THEN 'ship_m' WHEN 3 THEN 'ship_l' ELSE 'ship_xl' END AS class, 'C' || c_custkey AS code, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END AS name, 'm' || c_custkey % 90 AS macro FROM customer),
 posts AS (SELECT o_custkey AS obj, CASE o_orderkey % 6 WHEN 0 THEN 'manager' WHEN 1 THEN 'engineer' WHEN 2 THEN 'shiptrader' WHEN 3 THEN 'aipilot' ELSE 'other' END AS post, o_orderkey % 4000 AS person FROM orders), held AS (SELECT obj AS id, min(person) FILTER (post = 'manager') AS manager, min(person) FILTER (post = 'engineer') AS engineer, min(person) FILTER (post = 'shiptrader') AS shiptrader, min(person) FILTER (post = 'aipilot') AS aipilot FROM posts GROUP BY obj),
 persons AS (SELECT DISTINCT o_orderkey % 4000 AS id, 'P' || o_orderkey % 4000 AS name, o_orderkey % 4000 % 15 AS piloting FROM orders WHERE o_orderkey % 3 <> 1)"""


def fleet(spark, sf_dir):
    k, o, c = F.col("c_custkey"), F.col("o_orderkey"), table(spark, sf_dir, "customer")
    kind = F.when(k % 5 == 0, "station").when(k % 5 == 1, "ship_s").when(k % 5 == 2, "ship_m").when(k % 5 == 3, "ship_l").otherwise("ship_xl")
    owned = c.select(k.alias("id"), kind.alias("class"), text("C", k).alias("code"), F.when(k % 3 != 0, F.col("c_name")).otherwise("").alias("name"), text("m", k % 90).alias("macro"))
    post = F.when(o % 6 == 0, "manager").when(o % 6 == 1, "engineer").when(o % 6 == 2, "shiptrader").when(o % 6 == 3, "aipilot").otherwise("other")
    orders = table(spark, sf_dir, "orders")
    posts = orders.select(F.col("o_custkey").alias("object"), post.alias("post"), (o % 4000).alias("person"))
    persons = orders.filter(o % 3 != 1).select((o % 4000).alias("id")).distinct().select("id", text("P", F.col("id")).alias("name"), (F.col("id") % 15).alias("piloting"), F.lit("none").alias("role"))
    people = orders.select(F.col("o_custkey").alias("object"), F.when(o % 3 == 0, "service").when(o % 3 == 1, "marine").otherwise("guest").alias("role"), (o % 11).alias("count"))
    models = table(spark, sf_dir, "part").filter("p_partkey < 70").select(text("m", F.col("p_partkey")).alias("macro"), text("Model ", F.col("p_partkey")).alias("model"), (F.col("p_size") * 10).alias("crew"), F.col("p_partkey").alias("ord"))
    rollups = c.select(k.alias("id"), (k * 10).alias("entity_id"), (k % 7).alias("workforce"))
    return E.ships(owned, models, people, posts, persons), E.stations(owned, posts, rollups), persons


@query(f"""WITH {FLEET_SQL}, cr AS (SELECT o_custkey AS id, sum(o_orderkey % 11)::BIGINT AS crew FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1), mo AS (SELECT 'm' || p_partkey AS macro, 'Model ' || p_partkey AS model, p_size * 10 AS crew_most FROM part WHERE p_partkey < 70)
 SELECT own.id, code, coalesce(nullif(own.name, ''), model, macro) AS name, macro, upper(replace(class, 'ship_', '')) AS size, model, coalesce(crew, 0) AS crew, crew_most, aipilot, engineer, persons.name AS pilot_name, piloting AS pilot_skill FROM own LEFT JOIN mo USING (macro) LEFT JOIN cr ON cr.id = own.id LEFT JOIN held ON held.id = own.id LEFT JOIN persons ON persons.id = aipilot WHERE class <> 'station'""")
def dom05_ships(spark, sf_dir):
    return fleet(spark, sf_dir)[0]


@query(f"WITH {FLEET_SQL} SELECT own.id, class, code, name, macro, manager AS manager_id, engineer AS engineer_id, shiptrader AS shiptrader_id, own.id * 10 AS entity_id, own.id % 7 AS workforce FROM own LEFT JOIN held ON held.id = own.id WHERE class = 'station'")
def dom04_stations(spark, sf_dir):
    return fleet(spark, sf_dir)[1]


@query(f"""WITH {FLEET_SQL}, h AS (SELECT class = 'station' AS st, held.* FROM own JOIN held ON held.id = own.id), x AS (SELECT aipilot AS id, 0 AS k, 'pilot (ship)' AS role FROM h WHERE NOT st UNION ALL SELECT engineer, 1, 'engineer (ship)' FROM h WHERE NOT st UNION ALL SELECT manager, 2, 'manager (station)' FROM h WHERE st UNION ALL SELECT engineer, 3, 'engineer (station)' FROM h WHERE st UNION ALL SELECT shiptrader, 4, 'shiptrader (station)' FROM h WHERE st),
 b AS (SELECT id, arg_max(role, k) AS role FROM x WHERE id IS NOT NULL GROUP BY id) SELECT persons.id, name, piloting, coalesce(b.role, 'none') AS role FROM persons LEFT JOIN b ON b.id = persons.id""")
def dom05_roles(spark, sf_dir):
    own_ships, own_stations, persons = fleet(spark, sf_dir)
    return E.roles(persons, own_ships, own_stations)


PARTIES_SQL = f"{TRADES_SQL}, x AS (SELECT t, total AS money, amount, 'w' || ware AS ware, CASE WHEN seller % 3 = 0 THEN 'PLA' WHEN seller % 3 = 1 THEN 'ARG' END AS seller_faction, 'S' || seller AS seller_code, CASE WHEN buyer % 4 = 0 THEN 'PLA' WHEN buyer % 4 = 1 THEN 'TEL' END AS buyer_faction, 'B' || buyer AS buyer_code FROM trades)"


def parties(spark, sf_dir):
    s, b = F.col("seller"), F.col("buyer")
    return trades(spark, sf_dir).select("t", F.col("total").alias("money"), "amount", text("w", F.col("ware")).alias("ware"), F.when(s % 3 == 0, "PLA").when(s % 3 == 1, "ARG").alias("seller_faction"), text("S", s).alias("seller_code"), text("N", s).alias("seller_name"), F.when(b % 4 == 0, "PLA").when(b % 4 == 1, "TEL").alias("buyer_faction"), text("B", b).alias("buyer_code"), text("N", b).alias("buyer_name"))


@query(f"WITH {PARTIES_SQL} SELECT t, money, amount, ware, seller_code, buyer_faction, buyer_code FROM x WHERE seller_faction = 'PLA' AND buyer_faction IS DISTINCT FROM 'PLA' UNION ALL SELECT epoch_us(o_orderdate) / 1e6, o_totalprice, 1, 'Ship repair', 'S1', 'ARG', 'B' || o_custkey FROM orders WHERE o_orderstatus = 'P'")
def dom07_sales(spark, sf_dir):
    services = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(seconds("o_orderdate").alias("t"), F.col("o_totalprice").alias("money"), F.lit(1.0).alias("amount"), F.lit("Ship repair").alias("ware"), F.lit("Yard").alias("seller_name"), F.lit("S1").alias("seller_code"), F.lit("ARG").alias("buyer_faction"), F.lit("").alias("buyer_name"), text("B", F.col("o_custkey")).alias("buyer_code"))
    return E.sales(parties(spark, sf_dir), services).select("t", "money", "amount", "ware", "seller_code", "buyer_faction", "buyer_code")


@query(f"WITH {PARTIES_SQL} SELECT t, -money AS money, amount, ware, buyer_code, seller_faction, seller_code FROM x WHERE seller_faction IS DISTINCT FROM 'PLA' AND buyer_faction = 'PLA'")
def dom07_buys(spark, sf_dir):
    return E.buys(parties(spark, sf_dir)).select("t", "money", "amount", "ware", "buyer_code", "seller_faction", "seller_code")


@query(f"WITH {TRADES_SQL} SELECT max(t) AS now, ROUND((max(t) - min(t)) / 3600, 4) AS logged_hours FROM trades")
def dom08_clock(spark, sf_dir):
    return E.clock(trades(spark, sf_dir), END98).withColumn("logged_hours", r("logged_hours"))
