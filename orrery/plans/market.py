"""Queries of the market operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import market as K

from .relational import EPOCHS_SQL, flowing, query, r
from .roles import OFFERS_SQL, STOCK_SQL, TRADES_SQL, offers, seconds, stock, table, trades

#: Wares of the event streams in the roles of build materials and minables.
BUILD, MINABLE = ("purchase", "signup"), ("click",)
FLOWS_SQL = f"{EPOCHS_SQL}, f AS (SELECT owner, ware, sum(coalesce(greatest(delta, 0), 0)) AS inflow, sum(coalesce(greatest(-delta, 0), 0)) AS outflow FROM d GROUP BY ALL)"


def wares(spark, names):
    return spark.createDataFrame([(n,) for n in names], "ware string")


def pairs(spark, sf_dir, rest: int):
    """Owners of one remainder of three, with the wares that they have."""
    return table(spark, sf_dir, "events").filter(F.col("user_id") % 3 == rest).select(F.col("user_id").alias("owner"), F.col("event_type").alias("ware")).distinct()


def yards(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("user_id % 5 = 0").select(F.col("user_id").alias("owner")).distinct()


@query("""WITH m AS (SELECT l_suppkey AS station, s_nationkey AS faction, p_size AS method, count(*) AS n, 1.0 / (1 + p_size % 3) AS weight FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
 rec AS (SELECT p_size AS method, p_type AS ware, max(p_partkey % 90 + 1) AS amount, 60.0 + p_size AS seconds FROM part GROUP BY ALL), inp AS (SELECT p_size AS method, p_brand AS input, min(p_partkey % 7 + 1) AS needed FROM part GROUP BY ALL),
 runs AS (SELECT *, n * weight / seconds * 3600 AS runs FROM m JOIN rec USING (method))
 SELECT station, faction, ware, ROUND(sum(made), 4) AS made, ROUND(sum(used), 4) AS used FROM (SELECT station, faction, ware, runs * amount AS made, 0 AS used FROM runs UNION ALL SELECT station, faction, input, 0, runs * needed FROM runs JOIN inp USING (method)) GROUP BY ALL""")
def dom20_capacity(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    modules = table(spark, sf_dir, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    modules = modules.groupBy(F.col("l_suppkey").alias("station"), F.col("s_nationkey").alias("faction"), F.col("p_size").alias("method")).agg(F.count("*").alias("n")).withColumn("weight", 1 / (1 + F.col("method") % 3))
    recipes = p.groupBy(F.col("p_size").alias("method"), F.col("p_type").alias("ware")).agg(F.max(F.col("p_partkey") % 90 + 1).alias("amount")).withColumn("seconds", 60.0 + F.col("method"))
    inputs = p.groupBy(F.col("p_size").alias("method"), F.col("p_brand").alias("input")).agg(F.min(F.col("p_partkey") % 7 + 1).alias("needed"))
    return K.capacity(modules, recipes, inputs).select("station", "faction", "ware", r("made").alias("made"), r("used").alias("used"))


@query(f"""WITH {FLOWS_SQL}, s AS (SELECT ware, sum(CASE WHEN owner % 5 = 0 THEN inflow ELSE 0 END) AS taken, sum(CASE WHEN owner % 3 = 0 THEN outflow ELSE 0 END) AS given, bool_or(owner % 5 <> 0 AND owner % 3 <> 0 AND inflow > 0) AS dual FROM f WHERE ware IN ('purchase', 'signup') GROUP BY ware)
 SELECT ware, ROUND(CASE WHEN dual THEN taken ELSE greatest(taken, given) END / 720, 4) AS rate, CASE WHEN dual THEN 'floor' ELSE 'flow' END AS basis FROM s""")
def dom21_construction(spark, sf_dir):
    out = K.construction(flowing(spark, sf_dir), yards(spark, sf_dir), pairs(spark, sf_dir, 0), wares(spark, BUILD), 720)
    return out.withColumn("rate", r("rate"))


def rates(spark, sf_dir):
    return K.actual_flows(flowing(spark, sf_dir), pairs(spark, sf_dir, 0), pairs(spark, sf_dir, 1), yards(spark, sf_dir), wares(spark, BUILD), wares(spark, MINABLE))


RATES_SQL = f"""{FLOWS_SQL}, rates AS (SELECT ware, sum(CASE WHEN ware = 'click' THEN CASE WHEN owner % 3 = 1 THEN inflow ELSE inflow - outflow END WHEN owner % 3 = 0 THEN inflow ELSE 0 END) AS production,
 sum(CASE WHEN owner % 3 = 1 AND NOT (owner % 5 = 0 AND ware IN ('purchase', 'signup')) THEN outflow ELSE 0 END) AS consumption FROM f GROUP BY ware)"""


@query(f"WITH {RATES_SQL} SELECT ware, ROUND(production, 2) AS production, ROUND(consumption, 2) AS consumption FROM rates")
def dom22_actual_flows(spark, sf_dir):
    return rates(spark, sf_dir).select("ware", r("production", 2).alias("production"), r("consumption", 2).alias("consumption"))


@query(f"""WITH {OFFERS_SQL}, o AS (SELECT CASE WHEN ware % 50 = 0 THEN NULL ELSE ware END AS ware, sum(amount) FILTER (side = 'sell') AS held, sum(amount) FILTER (side = 'buy') AS wanted, avg(price) FILTER (side = 'sell') AS ask, avg(price) FILTER (side = 'buy') AS bid, count(*) FILTER (side = 'sell') AS sellers, count(*) FILTER (side = 'buy') AS buyers FROM offers WHERE ware % 50 <> 0 GROUP BY 1),
 q AS (SELECT p_partkey AS ware, p_retailprice / 10 AS production, p_size * 3.0 AS consumption FROM part WHERE p_partkey % 4 <> 0),
 s AS (SELECT coalesce(o.ware, q.ware) AS ware, coalesce(held, 0) AS held, coalesce(wanted, 0) AS wanted, ask, bid, coalesce(sellers, 0) AS sellers, coalesce(buyers, 0) AS buyers, coalesce(production, 0) AS production, coalesce(consumption, 0) AS consumption FROM o FULL JOIN q ON o.ware = q.ware)
 SELECT ware, ROUND(held, 2) AS held, ROUND(wanted, 2) AS wanted, sellers, buyers, ROUND(production, 2) AS production, ROUND(consumption, 2) AS consumption, ROUND(production - consumption, 2) AS balance, ROUND(CASE WHEN consumption > 0 THEN held / consumption END, 4) AS cover, ROUND(CASE WHEN held + wanted > 0 THEN held / (held + wanted) * 100 END, 4) AS fill, held * 3 < wanted AS understocked,
 ROUND(CASE WHEN ask > 0 THEN (bid / ask - 1) * 100 END, 4) AS premium, ROUND(CASE WHEN production - consumption > 0 THEN wanted / (production - consumption) END, 4) AS satisfy_h, CASE WHEN wanted = 0 THEN '' WHEN production <= consumption THEN 'never' WHEN wanted / (production - consumption) > 168 THEN 'backlog' ELSE 'sat' END AS satisfy FROM s""")
def dom23_ware_summary(spark, sf_dir):
    q = table(spark, sf_dir, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("ware"), (F.col("p_retailprice") / 10).alias("production"), (F.col("p_size") * 3.0).cast("double").alias("consumption"))
    s = K.summary(offers(spark, sf_dir).filter("ware % 50 <> 0"), q)
    two, four = ("held", "wanted", "production", "consumption", "balance"), ("cover", "fill", "premium", "satisfy_h")
    return s.withColumns({c: r(c, 2) for c in two} | {c: r(c) for c in four})


@query(f"WITH {TRADES_SQL} SELECT ware, floor(t / 2592000)::BIGINT AS bin, ROUND(sum(amount), 2) AS volume, ROUND(sum(total), 2) AS money FROM trades GROUP BY ALL")
def dom24_volume(spark, sf_dir):
    return K.hourly(trades(spark, sf_dir), 2592000.0).select("ware", "bin", r("volume", 2).alias("volume"), r("money", 2).alias("money"))


@query(f"WITH {TRADES_SQL}, v AS (SELECT ware, seller, sum(amount) AS volume FROM trades GROUP BY ALL) SELECT ware, seller, ROUND(volume, 2) AS volume, row_number() OVER (PARTITION BY ware ORDER BY volume DESC, seller) AS place FROM v QUALIFY place <= 12")
def dom24_leaders(spark, sf_dir):
    return K.leaders(trades(spark, sf_dir)).withColumn("volume", r("volume", 2))


@query("SELECT DISTINCT l_partkey AS ware FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND l_returnflag = 'R'")
def dom25_build_wares(spark, sf_dir):
    yard = table(spark, sf_dir, "supplier").filter("s_nationkey < 5")
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(yard, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(F.col("l_partkey").alias("ware")).distinct()


POPULATION_SQL = """wf AS (SELECT 1 + c_custkey % 90 AS station, c_nationkey % 3 AS faction, c_mktsegment AS race, c_nationkey AS amount FROM customer), rec AS (SELECT * FROM (VALUES ('default', 100.0::DOUBLE, 60.0::DOUBLE), ('BUILDING', 40.0, 90.0), ('MACHINERY', 70.0, 30.0)) AS x(method, amount, seconds)), inp AS (SELECT * FROM (VALUES ('default', 'food', 5.0::DOUBLE), ('default', 'medicine', 1.0), ('BUILDING', 'food', 7.0), ('MACHINERY', 'oil', 2.5)) AS x(method, ware, needed))"""


@query(f"""WITH {POPULATION_SQL}, made AS (SELECT 1 + p_partkey % 90 AS station, p_size % 3 AS faction, CASE WHEN p_size % 2 = 0 THEN 'food' ELSE 'oil' END AS ware, p_size * 1.0 AS made FROM part WHERE p_partkey % 4 = 0),
 every AS (SELECT wf.station, wf.faction, inp.ware, 0.0 AS made, needed / rec.amount / seconds * 3600 * wf.amount AS used FROM wf JOIN rec ON rec.method = CASE WHEN race IN ('BUILDING', 'MACHINERY') THEN race ELSE 'default' END JOIN inp USING (method) WHERE wf.amount > 0
  UNION ALL SELECT l_suppkey, l_suppkey % 3, 'condensate', 0, 1.0 FROM lineitem WHERE l_partkey % 25 = 0 UNION ALL SELECT station, faction, ware, made, 0 FROM made)
 SELECT station, faction, ware, ROUND(sum(made), 4) AS made, ROUND(sum(used), 4) AS used FROM every GROUP BY ALL""")
def dom20_population(spark, sf_dir):
    c, p, l = (table(spark, sf_dir, t) for t in ("customer", "part", "lineitem"))
    workers = c.select((1 + F.col("c_custkey") % 90).alias("station"), (F.col("c_nationkey") % 3).cast("long").alias("faction"), F.col("c_mktsegment").alias("race"), F.col("c_nationkey").cast("double").alias("amount"))
    recipes = spark.createDataFrame([("default", 100.0, 60.0), ("BUILDING", 40.0, 90.0), ("MACHINERY", 70.0, 30.0)], "method string, amount double, seconds double")
    inputs = spark.createDataFrame([("default", "food", 5.0), ("default", "medicine", 1.0), ("BUILDING", "food", 7.0), ("MACHINERY", "oil", 2.5)], "method string, input string, needed double")
    made = p.filter("p_partkey % 4 = 0").select((1 + F.col("p_partkey") % 90).alias("station"), (F.col("p_size") % 3).cast("long").alias("faction"), F.when(F.col("p_size") % 2 == 0, "food").otherwise("oil").alias("ware"), (F.col("p_size") * 1.0).alias("made"), F.lit(0.0).alias("used"))
    modules = l.select(F.col("l_suppkey").alias("station"), (F.col("l_suppkey") % 3).alias("faction"), F.when(F.col("l_partkey") % 25 == 0, "shield").otherwise("hall").alias("macro"))
    return K.rates(made, K.population(workers, recipes, inputs), K.shields(modules, "shield")).withColumns({"made": r("made"), "used": r("used")})


VIEW_SQL = f"""{OFFERS_SQL}, of AS (SELECT ware, owner AS station, side, price / amount AS price, amount, owner % 7 = 0 AS site, place AS faction, owner % 30 AS sector FROM offers WHERE ware % 3 <> 0), w AS (SELECT p_partkey AS ware, p_name AS name, p_retailprice AS price_avg, CASE p_size % 5 WHEN 0 THEN 'inventory' WHEN 1 THEN 'solid' ELSE 'container' END AS transport, p_size::DOUBLE AS volume, CASE WHEN p_partkey % 10 = 1 THEN 'economy minable' ELSE 'economy' END AS tags FROM part WHERE p_partkey % 17 <> 0)"""


def view(spark, sf_dir):
    """Offers and wares of the market's overview."""
    o = offers(spark, sf_dir).filter("ware % 3 <> 0").select("ware", F.col("owner").alias("station"), "side", (F.col("price") / F.col("amount")).alias("price"), "amount", (F.col("owner") % 7 == 0).alias("site"), F.col("place").alias("faction"), (F.col("owner") % 30).alias("sector"))
    k = F.col("p_partkey")
    w = table(spark, sf_dir, "part").filter("p_partkey % 17 <> 0").select(k.alias("ware"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price_avg"), F.when(F.col("p_size") % 5 == 0, "inventory").when(F.col("p_size") % 5 == 1, "solid").otherwise("container").alias("transport"), F.col("p_size").cast("double").alias("volume"), F.when(k % 10 == 1, "economy minable").otherwise("economy").alias("tags"))
    return o, w


@query(f"""WITH {VIEW_SQL}, cap AS (SELECT p_partkey AS ware, p_size * 2.0::DOUBLE AS made, p_partkey % 90 * 1.0::DOUBLE AS used FROM part WHERE p_partkey % 5 <> 0), held AS (SELECT l_suppkey AS station, l_partkey AS ware, sum(l_quantity) AS held FROM lineitem WHERE l_linenumber = 4 GROUP BY ALL), tr AS (SELECT l_partkey AS ware, sum(l_quantity) AS traded FROM lineitem WHERE l_linenumber = 5 GROUP BY 1),
 sp AS (SELECT greatest((max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) / 3600e6, 1.0) AS span FROM lineitem WHERE l_linenumber = 5), stock AS (SELECT ware, sum(held) AS stock FROM held GROUP BY ware), b AS (SELECT ware, sum(amount) FILTER (NOT site) AS buy, sum(amount) FILTER (site) AS build, max(price) AS best, sum(amount * price) AS worth FROM of WHERE side = 'buy' GROUP BY ware),
 wt AS (SELECT station, ware, sum(amount) AS wanted FROM of WHERE side = 'buy' GROUP BY ALL), bu AS (SELECT ware, count(*) AS buyers, count(*) FILTER (ROUND(coalesce(held, 0) - wanted / 3, 6) < 0) AS under, sum(coalesce(held, 0)) AS has, sum(coalesce(held, 0) + wanted) AS target FROM wt LEFT JOIN held USING (station, ware) GROUP BY ware),
 con AS (SELECT p_partkey AS ware, p_size * 0.4::DOUBLE AS rate, CASE WHEN p_size % 2 = 0 THEN 'floor' ELSE 'flow' END AS basis FROM part WHERE p_partkey % 8 = 3), act AS (SELECT p_partkey AS ware, p_size * 1.7::DOUBLE AS production, p_size * 0.6::DOUBLE AS consumption FROM part WHERE p_partkey % 6 <> 0),
 k AS (SELECT ware FROM cap UNION SELECT ware FROM tr UNION SELECT ware FROM stock),
 x AS (SELECT k.ware, name, coalesce(price_avg, 0) AS price_avg, coalesce(volume, 0) AS volume, coalesce(contains(tags, 'minable'), false) AS est, CASE WHEN coalesce(contains(tags, 'minable'), false) THEN coalesce(production, 0) ELSE coalesce(made, 0) END AS prod, coalesce(used, 0) AS cons, rate, coalesce(basis, '') AS basis, coalesce(used, 0) + coalesce(rate, 0) AS every, coalesce(stock, 0) AS stock, coalesce(buy, 0) AS buy, coalesce(build, 0) AS build, coalesce(traded, 0) / span AS th, best, coalesce(worth, 0) AS worth, coalesce(buyers, 0) AS buyers, coalesce(under, 0) AS under, has, target, coalesce(production, 0) AS pa, coalesce(consumption, 0) AS ca
  FROM k CROSS JOIN sp LEFT JOIN cap USING (ware) LEFT JOIN tr USING (ware) LEFT JOIN stock USING (ware) LEFT JOIN w USING (ware) LEFT JOIN b USING (ware) LEFT JOIN bu USING (ware) LEFT JOIN con USING (ware) LEFT JOIN act USING (ware) WHERE coalesce(transport, 'container') <> 'inventory')
 SELECT ware, coalesce(name, ware::VARCHAR) AS name, round_even(ROUND(prod, 9), 0) AS prod, round_even(ROUND(cons, 9), 0) AS cons, round_even(ROUND(prod - every, 9), 0) AS balance, round_even(ROUND(stock, 9), 0) AS stock, round_even(ROUND(CASE WHEN every > 0 THEN stock / every END, 9), 1) AS cover, round_even(buy, 0) AS buy, round_even(ROUND(rate, 9), 0) AS constr_h, basis AS constr_flag, buyers, under, round_even(build, 0) AS build, round_even(ROUND(th, 9), 0) AS traded_h, round_even(ROUND(th * price_avg, 9), 0) AS cr_h, est, round_even(CASE WHEN best > 0 THEN ROUND(best, 9) END, 0) AS best_price,
 round_even(ROUND(CASE WHEN price_avg > 0 AND best > 0 THEN (best / price_avg - 1) * 100 END, 9), 1) AS premium, round_even(ROUND(worth, 9), 0) AS demand_cr, round_even(ROUND(CASE WHEN target > 0 THEN has / target * 100 END, 9), 1) AS fill, round_even(ROUND(CASE WHEN buy + build <= 0 THEN 0 WHEN ROUND(prod - cons, 6) > 0 THEN (buy + build) / ROUND(prod - cons, 6) WHEN th > 0 THEN (buy + build) / th END, 9), 1) AS satisfy_h, CASE WHEN buy + build <= 0 THEN 'sat' WHEN ROUND(prod - cons, 6) > 0 THEN '' WHEN th > 0 THEN 'backlog' ELSE 'never' END AS satisfy_flag, volume::INT AS vol, round_even(ROUND(pa, 9), 0) AS prod_act, round_even(ROUND(ca, 9), 0) AS cons_act FROM x""")
def dom23_overview(spark, sf_dir):
    o, w = view(spark, sf_dir)
    p, l, k, size = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), F.col("p_partkey"), F.col("p_size")
    capacity = p.filter("p_partkey % 5 <> 0").select(k.alias("ware"), (size * 2.0).alias("made"), (k % 90 * 1.0).alias("used"))
    cargo = l.filter("l_linenumber = 4").select(F.col("l_suppkey").alias("station"), F.col("l_partkey").alias("ware"), F.col("l_quantity").alias("amount"))
    traded = l.filter("l_linenumber = 5").select(F.col("l_partkey").alias("ware"), seconds("l_shipdate").alias("t"), F.col("l_quantity").alias("amount"))
    built = p.filter("p_partkey % 8 = 3").select(k.alias("ware"), (size * 0.4).alias("rate"), F.when(size % 2 == 0, "floor").otherwise("flow").alias("basis"))
    actual = p.filter("p_partkey % 6 <> 0").select(k.alias("ware"), (size * 1.7).alias("production"), (size * 0.6).alias("consumption"))
    return K.overview(w, capacity, o, cargo, traded, built, actual)


@query(f"""WITH {STOCK_SQL}, now AS (SELECT max(t) AS now FROM stock), h AS (SELECT owner, ware, trunc((t - now) / 86400)::BIGINT AS hour, arg_max(level, (t, ord)) AS level FROM stock, now WHERE owner % 4 = 0 GROUP BY ALL), g AS (SELECT ware, owner, unnest(generate_series(first, 0)) AS hour FROM (SELECT DISTINCT ware, owner FROM h) JOIN (SELECT ware, min(hour) AS first FROM h GROUP BY ware) USING (ware)),
 e AS (SELECT ware, owner, max(hour) AS last FROM h WHERE owner % 8 = 0 GROUP BY ALL HAVING max(hour) < 0), x AS (SELECT ware, owner, hour, level FROM h UNION ALL SELECT ware, owner, last + 1, 0 FROM e), f AS (SELECT g.ware, g.hour, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY g.ware, g.owner ORDER BY g.hour ROWS UNBOUNDED PRECEDING), first_value(level IGNORE NULLS) OVER (PARTITION BY g.ware, g.owner ORDER BY g.hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM g LEFT JOIN x ON x.ware = g.ware AND x.owner = g.owner AND x.hour = g.hour)
 SELECT ware, hour, ROUND(sum(level), 3) AS stock FROM f GROUP BY ALL""")
def dom24_stock_trend(spark, sf_dir):
    s = stock(spark, sf_dir)
    now = s.agg(F.max("t").alias("now"))  # a row
    levels = s.filter("owner % 4 = 0").join(F.broadcast(now), F.lit(True)).select("owner", "ware", ((F.col("t") - F.col("now")) / 86400).cast("long").alias("hour"), F.struct("t", "ord").alias("ord"), "level")
    return K.stock_trend(levels, s.filter("owner % 8 = 0")).withColumn("stock", r("stock", 3))


@query("WITH c AS (SELECT p_type AS ware, p_size % 7 AS faction, sum(p_retailprice) AS made, sum(p_size) * 1.0 AS used FROM part GROUP BY ALL) SELECT ware, faction, ROUND(made, 2) AS made, ROUND(used, 2) AS used, row_number() OVER (PARTITION BY ware ORDER BY ROUND(made + used, 6) DESC, faction) AS place FROM c")
def dom24_by_faction(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("ware"), (F.col("p_size") % 7).alias("faction"), F.col("p_retailprice").alias("made"), (F.col("p_size") * 1.0).alias("used"))
    return K.by_faction(p).withColumns({"made": r("made", 2), "used": r("used", 2)})


@query(f"""WITH {VIEW_SQL}, s AS (SELECT ware, 'sector' AS by, sector AS name, sum(CASE WHEN site THEN 0 ELSE amount END) AS buy, sum(CASE WHEN site THEN amount ELSE 0 END) AS build FROM of WHERE side = 'buy' GROUP BY ALL), f AS (SELECT ware, 'faction' AS by, faction AS name, sum(CASE WHEN site THEN 0 ELSE amount END) AS buy, sum(CASE WHEN site THEN amount ELSE 0 END) AS build FROM of WHERE side = 'buy' GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY ware ORDER BY buy + build DESC, name) AS place FROM s QUALIFY place <= 12 UNION ALL SELECT *, row_number() OVER (PARTITION BY ware ORDER BY buy + build DESC, name) FROM f""")
def dom24_unmet(spark, sf_dir):
    o, _ = view(spark, sf_dir)
    part = lambda by, most: K.unmet(o, by, most).select("ware", F.lit(by).alias("by"), F.col(by).cast("long").alias("name"), "buy", "build", "place")
    return part("sector", K.SECTORS).unionByName(part("faction", None))


@query(f"WITH {VIEW_SQL} SELECT ware, side, row_number() OVER (PARTITION BY ware, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END, station, amount) AS place, station, price, amount FROM of")
def dom24_books(spark, sf_dir):
    return K.books(view(spark, sf_dir)[0])
