"""Queries of the audits, of raw supply and of the price book over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import pricing as P
from orrery.operators import audit as A
from orrery.operators import books as B
from orrery.operators import joins as J

from .relational import query, r
from .roles import seconds, table

LINE_SQL = "line AS (SELECT l_suppkey AS station, l_partkey % 30 AS ware, l_quantity::DOUBLE AS amount, l_linenumber AS k, l_orderkey AS o, l_returnflag AS flag, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station"), (F.col("l_partkey") % 30).alias("ware"), F.col("l_quantity").cast("double").alias("amount"), F.col("l_linenumber").alias("k"), F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("flag"), seconds("l_shipdate").alias("t"))


@query(f"""WITH {LINE_SQL}, used AS (SELECT station, ware, sum(amount) AS used FROM line WHERE k = 1 GROUP BY ALL), held AS (SELECT station, ware, sum(amount) AS stock FROM line WHERE k > 2 AND ware % 7 <> 0 GROUP BY ALL)
 SELECT station, ware, used, coalesce(stock, 0) AS stock, ROUND(coalesce(stock, 0) / used, 4) AS cover, CASE WHEN coalesce(stock, 0) <= 0 THEN 'stalled' ELSE 'low' END AS status FROM used LEFT JOIN held USING (station, ware) WHERE ROUND(coalesce(stock, 0) / used, 6) < 3""")
def dom40_starving(spark, sf_dir):
    l = lines(spark, sf_dir)
    return A.starving(l.filter("k = 1").groupBy("station", "ware").agg(F.sum("amount").alias("used")), l.filter("k > 2 AND ware % 7 <> 0")).withColumn("cover", r("cover"))


@query(f"""WITH {LINE_SQL}, v AS (SELECT *, 'k' || (ware % 4) AS transport, (1 + ware % 5)::DOUBLE AS volume FROM line),
 stores AS (SELECT s_suppkey AS station, unnest([' k0 k1', 'k2', 'k3']) AS tags, unnest([1, 2, 3]) AS n FROM supplier), room AS (SELECT station, tags, (SELECT avg(c) FROM (SELECT sum(amount * volume) AS c FROM v WHERE k > 2 GROUP BY station)) * n / 6 AS capacity FROM stores),
 held AS (SELECT station, transport, sum(amount * volume) AS held FROM v WHERE k > 2 GROUP BY ALL), net AS (SELECT station, transport, sum(amount / 100 * (CASE WHEN k = 1 THEN 1 ELSE -1 END) * volume) AS net FROM v WHERE k < 3 GROUP BY ALL),
 s AS (SELECT room.station, tags, capacity, coalesce(sum(held), 0) AS used, coalesce(sum(net), 0) AS net FROM room LEFT JOIN held ON held.station = room.station AND contains(tags, held.transport) LEFT JOIN net ON net.station = room.station AND contains(tags, net.transport) AND net.transport = held.transport GROUP BY ALL)
 SELECT station, tags, ROUND(capacity, 2) AS capacity, ROUND(used, 2) AS used, ROUND(used * 100 / capacity, 3) AS percent, ROUND(CASE WHEN ROUND(used - capacity, 6) >= 0 THEN 0 WHEN ROUND(net, 6) > 0 THEN (capacity - used) / net END, 3) AS hours FROM s WHERE ROUND(used * 100 / capacity, 6) > 80""")
def dom42_saturated(spark, sf_dir):
    l = lines(spark, sf_dir)
    wares = l.select("ware").distinct().select("ware", F.concat(F.lit("k"), F.col("ware") % 4).alias("transport"), (1.0 + F.col("ware") % 5).alias("volume"))
    cargo, net = l.filter("k > 2"), l.filter("k < 3").withColumn("rate", F.col("amount") / 100 * F.when(F.col("k") == 1, 1).otherwise(-1))
    usual = cargo.join(wares, "ware").groupBy("station").agg(F.sum(F.col("amount") * F.col("volume")).alias("c")).agg(F.avg("c").alias("c"))  # a row
    stores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.posexplode(F.array(F.lit(" k0 k1"), F.lit("k2"), F.lit("k3"))).alias("n", "tags")).crossJoin(F.broadcast(usual)).withColumn("capacity", F.col("c") * (F.col("n") + 1) / 6)
    return A.saturated(stores, cargo, wares, net).withColumns({"capacity": r("capacity", 2), "used": r("used", 2), "percent": r("percent", 3), "hours": r("hours", 3)})


@query("""WITH ships AS (SELECT c_custkey AS ship, CASE c_nationkey % 4 WHEN 0 THEN 'XS' WHEN 1 THEN 'S' WHEN 2 THEN 'M' ELSE 'L' END AS size FROM customer WHERE c_custkey % 6 <> 0),
 ord AS (SELECT o_custkey AS ship, o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN 'Wait' WHEN 1 THEN 'DockAt' ELSE 'Patrol' END AS name, o_orderkey % 8 <> 0 AS standing, CASE WHEN o_orderkey % 3 = 0 THEN 'started' WHEN o_orderkey % 3 = 1 THEN 'ready' END AS state FROM orders),
 t AS (SELECT ship, bool_or(NOT standing) AS busy, arg_min(name, ord) FILTER (standing) AS name, arg_min(coalesce(state, ''), ord) FILTER (standing) AS state FROM ord GROUP BY ship)
 SELECT ship, size, CASE WHEN name IS NULL THEN 'none' WHEN name IN ('Wait', 'DockAt') THEN name ELSE name || ' (not running)' END AS standing FROM ships LEFT JOIN t USING (ship) WHERE size <> 'XS' AND ship % 10 <> 1 AND NOT coalesce(busy, false) AND (name IS NULL OR name IN ('Wait', 'DockAt') OR state <> 'started')""")
def dom44_idle(spark, sf_dir):
    cust, n = table(spark, sf_dir, "customer"), F.col("c_nationkey") % 4
    ships = cust.filter("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("ship"), F.when(n == 0, "XS").when(n == 1, "S").when(n == 2, "M").otherwise("L").alias("size"))
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ship"), k.alias("ord"), F.when(k % 5 == 0, "Wait").when(k % 5 == 1, "DockAt").otherwise("Patrol").alias("name"), (k % 8 != 0).alias("standing"), F.when(k % 3 == 0, "started").when(k % 3 == 1, "ready").alias("state"))
    return A.idle(ships, orders, cust.filter("c_custkey % 10 = 1").select(F.col("c_custkey").alias("follower")))


@query("""WITH need AS (SELECT l_suppkey AS station, sum(p_size % 9) AS housing, sum(p_size % 7) AS wanted FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = l_partkey GROUP BY 1),
 have AS (SELECT 1 + c_custkey % 90 AS station, sum(c_nationkey) AS have FROM customer GROUP BY 1)
 SELECT station, coalesce(have, 0) AS have, wanted, coalesce(housing, 0) AS housing, ROUND(coalesce(have, 0) * 100.0::DOUBLE / wanted, 3) AS percent, coalesce(housing, 0) < wanted AS crowded FROM need LEFT JOIN have USING (station) WHERE wanted > 0 AND ROUND(coalesce(have, 0) - 0.9::DOUBLE * wanted, 6) < 0""")
def dom45_understaffed(spark, sf_dir):
    modules = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_partkey").alias("macro"))
    parts = table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("macro"), (F.col("p_size") % 9).alias("housing"), (F.col("p_size") % 7).alias("workers"))
    force = table(spark, sf_dir, "customer").select((1 + F.col("c_custkey") % 90).alias("station"), F.col("c_nationkey").alias("amount"))
    return A.understaffed(modules, parts, force).withColumn("percent", r("percent", 3))


@query("""WITH s AS (SELECT c_custkey AS ship, CASE c_nationkey % 5 WHEN 0 THEN 'XS' WHEN 1 THEN 'S' WHEN 2 THEN 'M' WHEN 3 THEN 'L' ELSE 'XL' END AS size, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS pilot, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS engineer, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 6 END AS skill, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 11 END AS crew, CASE WHEN c_custkey % 9 <> 0 THEN 6 END AS most FROM customer),
 x AS (SELECT ship, size, greatest(0, coalesce(most - coalesce(crew, 0), 0)) AS missing, concat_ws(', ', CASE WHEN pilot IS NULL THEN 'no captain' END, CASE WHEN engineer IS NULL AND size IN ('M', 'L', 'XL') THEN 'no engineer' END, CASE WHEN pilot IS NOT NULL AND size IN ('L', 'XL') AND skill < 3 THEN 'pilot skill ' || skill END) AS issues FROM s WHERE size <> 'XS')
 SELECT *, size = 'S' AND issues = '' AS minor FROM x WHERE issues <> '' OR missing > 0""")
def dom46_crew_gaps(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    size = F.when(n == 0, "XS").when(n == 1, "S").when(n == 2, "M").when(n == 3, "L").otherwise("XL")
    return A.crew_gaps(table(spark, sf_dir, "customer").select(k.alias("ship"), size.alias("size"), F.when(k % 7 != 0, k).alias("pilot"), F.when(k % 3 != 0, k).alias("engineer"), F.when(k % 4 != 0, k % 6).alias("skill"), F.when(k % 8 != 0, k % 11).alias("crew"), F.when(k % 9 != 0, 6).alias("crew_most")))


@query("""WITH m AS (SELECT p_partkey AS macro, p_brand AS class, p_size % 3 AS size, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_retailprice END AS hold FROM part), own AS (SELECT DISTINCT l_partkey AS macro, true AS own FROM lineitem WHERE l_suppkey = 1)
 SELECT class, size, ROUND(coalesce(median(hold) FILTER (own), median(hold)), 4) AS hold FROM m LEFT JOIN own USING (macro) WHERE hold > 0 GROUP BY ALL""")
def dom28_typical_hold(spark, sf_dir):
    models = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("macro"), F.col("p_brand").alias("class"), (F.col("p_size") % 3).alias("size"), F.when(F.col("p_partkey") % 13 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("hold"))
    own = table(spark, sf_dir, "lineitem").filter("l_suppkey = 1").select(F.col("l_partkey").alias("macro"))
    return A.typical_hold(models, own).withColumn("hold", r("hold"))


NOW = 904607000.0  # a day in September 1998

#: Days of the table stand for minutes of the window.
INFLOW_SQL = f"""{LINE_SQL}, d AS (SELECT station, ware, {NOW}::DOUBLE - ({NOW}::DOUBLE - t) / 1440 AS t, amount, o % 50 AS miner FROM line WHERE t <= {NOW}), w AS (SELECT station, ware, greatest(0.5::DOUBLE, least(6.0::DOUBLE, ({NOW}::DOUBLE - min(t)) / 3600)) AS window_h FROM d GROUP BY ALL),
 x AS (SELECT *, t >= {NOW}::DOUBLE - window_h * 3600 AS inside, (station + miner) % 3 = 0 AS mine FROM d JOIN w USING (station, ware)),
 inflow AS (SELECT station, ware, window_h, coalesce(sum(amount) FILTER (inside), 0) / window_h AS observed, coalesce(sum(amount) FILTER (inside AND mine), 0) / window_h AS own, count(*) FILTER (inside AND mine) AS n FROM x GROUP BY station, ware, window_h)"""


def raw_inflow(spark, sf_dir):
    d = lines(spark, sf_dir).filter(F.col("t") <= NOW).select("station", "ware", (F.lit(NOW) - (F.lit(NOW) - F.col("t")) / 1440).alias("t"), "amount", (F.col("o") % 50).alias("miner"))
    return A.inflow(d, d.filter("(station + miner) % 3 = 0"), NOW)


@query(f"WITH {INFLOW_SQL} SELECT station, ware, ROUND(window_h, 4) AS window_h, ROUND(observed, 4) AS observed, ROUND(own, 4) AS own, n FROM inflow")
def dom29_inflow(spark, sf_dir):
    return raw_inflow(spark, sf_dir).withColumns({k: r(k) for k in ("window_h", "observed", "own")})


@query(f"""WITH {INFLOW_SQL}, p AS (SELECT station, CASE ware % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END AS size, sum(CASE WHEN ware % 4 = 3 THEN 0 ELSE own END) / 200 AS measured, 100.0::DOUBLE + station % 9 AS hold, 5.0::DOUBLE * (station % 40) - sum(observed) AS gap FROM inflow GROUP BY station, ware % 4),
 u AS (SELECT size, median(measured) AS usual FROM p WHERE measured > 0 GROUP BY size), q AS (SELECT p.*, CASE WHEN measured > 0 THEN measured ELSE coalesce(usual, CASE size WHEN 'S' THEN 3.0::DOUBLE WHEN 'M' THEN 2 WHEN 'L' THEN 1 ELSE 0.8::DOUBLE END) END AS rate, CASE WHEN measured > 0 THEN 'measured' WHEN usual IS NOT NULL THEN 'empire' ELSE 'assumed' END AS source FROM p LEFT JOIN u USING (size))
 SELECT station, size, ROUND(rate, 5) AS rate, source, CASE WHEN ROUND(gap, 6) <= 0 THEN 0 WHEN hold * rate > 0 THEN ceil(ROUND(gap / (hold * rate), 6))::BIGINT END AS more FROM q""")
def dom29_pool_rates(spark, sf_dir):
    w = F.col("ware") % 4
    p = raw_inflow(spark, sf_dir).withColumn("size", F.when(w == 0, "S").when(w == 1, "M").when(w == 2, "L").otherwise("XL"))
    p = p.groupBy("station", "size").agg((F.sum(F.when(w == 3, 0.0).otherwise(F.col("own"))) / 200).alias("measured"), F.sum("observed").alias("_o")).withColumns({"hold": 100.0 + F.col("station") % 9, "gap": 5.0 * (F.col("station") % 40) - F.col("_o")})
    return A.pool_rates(p).select("station", "size", r("rate", 5).alias("rate"), "source", "more")


@query("""WITH meals AS (SELECT * FROM (VALUES ('default', 1), ('default', 2), ('BUILDING', 8)) m(race, ware)), wf AS (SELECT DISTINCT 1 + c_custkey % 90 AS station, c_mktsegment AS race FROM customer WHERE c_nationkey > 0)
 SELECT DISTINCT station, ware::BIGINT AS ware FROM wf JOIN meals ON meals.race = CASE WHEN wf.race = 'BUILDING' THEN 'BUILDING' ELSE 'default' END""")
def dom36_ration_pairs(spark, sf_dir):
    meals = spark.createDataFrame([("default", 1), ("default", 2), ("BUILDING", 8)], "race string, ware long")
    return B.ration_pairs(table(spark, sf_dir, "customer").select((1 + F.col("c_custkey") % 90).alias("station"), F.col("c_mktsegment").alias("race"), F.col("c_nationkey").alias("amount")), meals)


@query("""WITH built AS (SELECT DISTINCT l_suppkey AS station, CASE WHEN l_partkey % 20 = 0 THEN 'buildmodule' ELSE 'm' || (l_partkey % 20) END AS macro FROM lineitem WHERE l_linenumber = 1), makes AS (SELECT DISTINCT 'm' || (p_partkey % 20) AS macro, p_partkey % 20 AS ware, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE 'gone' END AS method FROM part),
 inputs AS (SELECT DISTINCT p_partkey % 20 AS ware, CASE p_partkey % 20 % 3 WHEN 0 THEN unnest(['own', 'default', 'x']) WHEN 1 THEN unnest(['default', 'x', 'x']) ELSE unnest(['x', 'y', 'y']) END AS method, unnest([100, 200, 300]) + p_partkey % 20 AS input FROM part),
 best AS (SELECT DISTINCT macro, input FROM (SELECT macro, m.ware, input, i.method, m.method AS own, CASE WHEN i.method = m.method THEN 0 WHEN i.method = 'default' THEN 1 ELSE 2 END AS k FROM makes m JOIN inputs i ON i.ware = m.ware) QUALIFY k = min(k) OVER (PARTITION BY macro, ware, own))
 SELECT station, input AS ware FROM built JOIN best USING (macro) UNION SELECT station, unnest([901, 902]) FROM built WHERE macro = 'buildmodule' UNION SELECT s_suppkey, 1 FROM supplier WHERE s_suppkey % 4 = 0""")
def dom36_consumed_pairs(spark, sf_dir):
    w = F.col("p_partkey") % 20
    built = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("station"), F.when(F.col("l_partkey") % 20 == 0, "buildmodule").otherwise(F.concat(F.lit("m"), F.col("l_partkey") % 20)).alias("macro"))
    makes = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), w).alias("macro"), w.alias("ware"), F.when(F.col("p_partkey") % 2 == 0, "own").otherwise("gone").alias("method")).distinct()
    three = lambda *m: F.array(*[F.struct(F.lit(x).alias("method"), F.lit(n).alias("n")) for x, n in zip(m, (100, 200, 300))])
    inputs = table(spark, sf_dir, "part").select(w.alias("ware")).distinct().select("ware", F.explode(F.when(F.col("ware") % 3 == 0, three("own", "default", "x")).when(F.col("ware") % 3 == 1, three("default", "x", "x")).otherwise(three("x", "y", "y"))).alias("i")).select("ware", "i.method", (F.col("i.n") + F.col("ware")).alias("input"))
    return B.consumed_pairs(built, makes, inputs, [901, 902], table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("station"), F.lit(1).alias("ware")))


BOOK_SQL = f"""WITH o AS (SELECT l_orderkey AS o, l_linenumber AS k, l_suppkey AS station, l_partkey AS ware, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_quantity::DOUBLE AS amount, CASE l_orderkey % 11 WHEN 0 THEN 'supplies' WHEN 1 THEN 'a shady' ELSE '' END AS flags, CASE WHEN l_suppkey % 6 = 0 THEN 'buildstorage' ELSE 'station' END AS host, CASE WHEN l_suppkey % 9 = 0 THEN 'player' ELSE 'x' END AS owner,
  p_retailprice * 0.75::DOUBLE AS low, p_retailprice AS mean, p_retailprice * 1.5::DOUBLE AS high, p_retailprice * (0.75::DOUBLE + ((l_orderkey * 8 + l_linenumber) % 97)::DOUBLE / 129) AS price, (100 + l_partkey % 50 * 20)::DOUBLE AS allocation, (l_quantity * 10)::DOUBLE AS net, (l_quantity * 2)::DOUBLE AS stock, 3.0::DOUBLE AS inbound,
  l_partkey % 23 = 0 AS manual, l_suppkey % 8 = 0 AS locked, l_suppkey % 5 = 0 AS yard, l_partkey % 7 = 0 AS ration, l_partkey % 2 = 0 AS consumed FROM lineitem JOIN part ON p_partkey = l_partkey),
 b AS (SELECT *, CASE WHEN owner = 'player' OR manual THEN 'player' WHEN contains(flags, 'supplies') THEN 'supplies' WHEN contains(flags, 'shady') THEN 'shady' WHEN locked THEN 'lockavgprice' WHEN host = 'buildstorage' THEN 'buildstorage' WHEN yard THEN 'yard' ELSE 'main' END AS book, ware IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_linestatus = 'F') AS has_sell FROM o),
 c AS (SELECT *, CASE WHEN book NOT IN ('main', 'yard') THEN book WHEN has_sell THEN 'supplier' WHEN ration THEN 'ration' ELSE 'input' END AS population, (price - mean) / CASE WHEN price >= mean THEN high - mean ELSE mean - low END AS s FROM b),
 off AS (SELECT station, median(acos(s) * {P.SPAN}::DOUBLE / pi() - net / allocation) AS shift FROM c WHERE book IN ('main', 'yard') AND population = 'input' AND side = 'buy' AND abs(s) < 1 GROUP BY station HAVING count(*) >= 2),
 e AS (SELECT c.*, CASE WHEN book = 'yard' THEN coalesce(shift, -0.202::DOUBLE) ELSE -0.039::DOUBLE END AS eater, least(allocation, 5000000.0::DOUBLE / mean) AS capped FROM c LEFT JOIN off USING (station)),
 f AS (SELECT *, CASE WHEN population = 'supplier' AND NOT (consumed AND net > capped) THEN capped ELSE allocation END AS target, CASE WHEN population = 'supplier' THEN CASE WHEN consumed AND net > capped THEN eater ELSE 0.053::DOUBLE END WHEN population = 'ration' THEN 0.006::DOUBLE ELSE eater END AS a FROM e),
 g AS (SELECT *, cos(pi() * greatest(0, least(1, (net / target + a) / {P.SPAN}::DOUBLE))) AS pos, abs(price - 2.75::DOUBLE * mean) <= abs(price - 1.042::DOUBLE * high) AS fixed FROM f),
 h AS (SELECT *, CASE WHEN book IN ('main', 'yard') THEN mean + pos * CASE WHEN pos < 0 THEN mean - low ELSE high - mean END WHEN book = 'lockavgprice' THEN mean - CASE WHEN side = 'buy' THEN 1 ELSE 0 END WHEN book = 'supplies' THEN mean + 0.5::DOUBLE * (high - mean) WHEN book = 'shady' THEN CASE WHEN fixed THEN 2.75::DOUBLE * mean ELSE 1.042::DOUBLE * high END
  WHEN book = 'buildstorage' THEN low + (high - low) * CASE WHEN (stock + inbound) / (stock + inbound + amount) <= 0.5::DOUBLE THEN 1 ELSE greatest(0, least(1, 1 - ((stock + inbound) / (stock + inbound + amount) - 0.5::DOUBLE) / 0.65::DOUBLE)) END END AS price_pred FROM g),
 book AS (SELECT *, (price - price_pred) / CASE WHEN price >= mean THEN high - mean ELSE mean - low END AS res FROM h)"""


def book(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("mean"))
    q, k, s, m = F.col("l_quantity").cast("double"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("mean")
    o = l.join(p, F.col("p_partkey") == F.col("l_partkey")).select(
        k.alias("o"), F.col("l_linenumber").alias("k"), s.alias("station"), F.col("l_partkey").alias("ware"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), q.alias("amount"),
        F.when(k % 11 == 0, "supplies").when(k % 11 == 1, "a shady").otherwise("").alias("flags"), F.when(s % 6 == 0, "buildstorage").otherwise("station").alias("host"), F.when(s % 9 == 0, "player").otherwise("x").alias("owner"),
        (m * 0.75).alias("low"), "mean", (m * 1.5).alias("high"), (m * (0.75 + ((k * 8 + F.col("l_linenumber")) % 97).cast("double") / 129)).alias("price"), (100.0 + F.col("l_partkey") % 50 * 20).alias("allocation"),
        (q * 10).alias("net"), (q * 2).alias("stock"), F.lit(3.0).alias("inbound"), (F.col("l_partkey") % 23 == 0).alias("manual"), (s % 8 == 0).alias("locked"), (s % 5 == 0).alias("yard"), (F.col("l_partkey") % 7 == 0).alias("ration"), (F.col("l_partkey") % 2 == 0).alias("consumed"),
    )
    sold = l.filter("l_linenumber = 1 AND l_linestatus = 'F'").select(F.col("l_partkey").alias("ware"))
    o = J.member(o, sold, ["ware"], "has_sell").withColumn("has_sell", F.col("has_sell") == 1)
    return B.classified(o)


@query(f"{BOOK_SQL} SELECT o, k, book, population, ROUND(price_pred, 3) AS price_pred, CASE WHEN book = 'shady' THEN CASE WHEN fixed THEN 'fixed' ELSE 'continuum' END END AS tier, ROUND(s, 4) AS s_obs, ROUND(res, 4) AS res FROM book")
def dom37_price_book(spark, sf_dir):
    return B.predicted(book(spark, sf_dir)).select("o", "k", "book", "population", r("price_pred", 3).alias("price_pred"), "tier", r("s_obs").alias("s_obs"), r("res").alias("res"))


@query(f"{BOOK_SQL} SELECT station, ROUND(shift, 5) AS shift FROM off")
def dom38_input_offsets(spark, sf_dir):
    return B.input_offsets(book(spark, sf_dir)).select("station", r("offset", 5).alias("shift"))


@query(f"{BOOK_SQL} SELECT population, count(*) AS n, ROUND(median(abs(res)), 4) AS median_res, ROUND(sqrt(avg(res * res)), 4) AS rmse FROM book WHERE res IS NOT NULL GROUP BY population")
def dom39_scores(spark, sf_dir):
    return B.scores(B.predicted(book(spark, sf_dir))).withColumns({"median_res": r("median_res"), "rmse": r("rmse")})
