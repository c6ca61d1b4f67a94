"""Queries of routes, storage pools, rations and munition over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import storage as S

from .relational import checkpoints, query, r
from .roles import table

ROUTES_SQL = """WITH RECURSIVE gate AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b, (n_nationkey * 37 % 101) * 1000.0::DOUBLE AS ax, (n_nationkey * 53 % 89) * 1000.0::DOUBLE AS az, (n_nationkey * 29 % 97) * 1000.0::DOUBLE AS bx, (n_nationkey * 71 % 83) * 1000.0::DOUBLE AS bz FROM nation),
 st AS (SELECT s_suppkey AS station, s_nationkey AS sector, (s_suppkey * 13 % 103) * 1000.0::DOUBLE AS x, (s_suppkey * 17 % 107) * 1000.0::DOUBLE AS z FROM supplier),
 step AS (SELECT 1 AS dir, a AS sector, ax AS x, az AS z, b AS next, bx AS nx, bz AS nz FROM gate UNION ALL SELECT -1, b, bx, bz, a, ax, az FROM gate),
 walk(source, dir, sector, x, z, plain, quick, n) AS (SELECT station, d, sector, x, z, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM st, (SELECT unnest([1, -1]) AS d)
  UNION ALL SELECT source, walk.dir, next, nx, nz, plain + CASE WHEN walk.sector % 4 = 0 THEN 0 ELSE sqrt((walk.x - step.x) ** 2 + (walk.z - step.z) ** 2) / 1000 END, quick + CASE WHEN walk.sector % 4 = 0 THEN sqrt((walk.x - step.x) ** 2 + (walk.z - step.z) ** 2) / 1000 ELSE 0 END, n + 1 FROM walk JOIN step ON step.sector = walk.sector AND step.dir = walk.dir WHERE n < 24),
 pair AS (SELECT a.station AS source, b.station AS target, a.sector = b.sector AS near, b.sector AS sector, b.x, b.z FROM st a JOIN st b ON b.station IN (a.station + 1, a.station + 7)),
 went AS (SELECT source, target, plain + CASE WHEN pair.sector % 4 = 0 THEN 0 ELSE sqrt((walk.x - pair.x) ** 2 + (walk.z - pair.z) ** 2) / 1000 END AS plain, quick + CASE WHEN pair.sector % 4 = 0 THEN sqrt((walk.x - pair.x) ** 2 + (walk.z - pair.z) ** 2) / 1000 ELSE 0 END AS quick FROM pair JOIN walk USING (source, sector) WHERE near = (n = 0))
 SELECT source, target, ROUND(arg_min(plain, plain + quick * 0.1), 4) AS plain_km, ROUND(arg_min(quick, plain + quick * 0.1), 4) AS highway_km FROM went GROUP BY source, target"""


@query(ROUTES_SQL)
def gr06_routes(spark, sf_dir):
    checkpoints(spark)
    k = F.col("n_nationkey")
    gates = table(spark, sf_dir, "nation").select(k.alias("sector_a"), ((k + 1) % 25).alias("sector_b"), *[(k * m % n * 1000.0).alias(c) for c, m, n in (("ax", 37, 101), ("az", 53, 89), ("bx", 29, 97), ("bz", 71, 83))])
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("sector"), (F.col("s_suppkey") * 13 % 103 * 1000.0).alias("x"), (F.col("s_suppkey") * 17 % 107 * 1000.0).alias("z"))
    wanted = s.select(F.col("station").alias("source"), F.explode(F.array(F.col("station") + 1, F.col("station") + 7)).alias("target"))
    found = G.routes(s, gates, table(spark, sf_dir, "nation").select(k.alias("sector"), (k % 4 == 0).alias("highway")), wanted)
    return found.select("source", "target", r("plain_km").alias("plain_km"), r("highway_km").alias("highway_km"))


STATIONS_SQL = """n AS (SELECT (SELECT count(*) FROM supplier) AS stations), goods AS (SELECT DISTINCT p_partkey % 30 AS ware FROM part),
 wares AS (SELECT ware, 'k' || (ware % 4) AS transport, (1 + ware % 5)::DOUBLE AS volume, ware % 11 <> 0 AS economy FROM goods WHERE ware % 29 <> 0),
 recipes AS (SELECT ware, method, (60 + ware)::DOUBLE AS seconds, (10 + ware)::DOUBLE AS amount, (ware % 4)::DOUBLE / 10 AS work FROM goods, (SELECT unnest(['default', 'other', 'processing']) AS method) WHERE method = 'default' OR (method = 'other' AND ware % 2 = 0) OR (method = 'processing' AND ware % 5 = 0)),
 inputs AS (SELECT ware, method AS used, (ware + 7) % 30 AS input, (2 + ware % 3)::DOUBLE AS needed FROM recipes),
 modules AS (SELECT l_suppkey AS station, p_size % 20 AS macro, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
 makes AS (SELECT p_size % 20 AS macro, p_partkey % 30 AS ware, CASE min(p_partkey) % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'other' ELSE 'processing' END AS method, 2.0::DOUBLE AS scale, 0.5::DOUBLE AS weight FROM part GROUP BY ALL),
 known AS (SELECT macro, m.ware, coalesce(e.method, d.method) AS used, scale * weight AS w, coalesce(e.seconds, d.seconds) AS seconds, coalesce(e.amount, d.amount) AS amount, coalesce(e.work, d.work) AS work FROM makes m LEFT JOIN recipes e ON e.ware = m.ware AND e.method = m.method LEFT JOIN recipes d ON d.ware = m.ware AND d.method = 'default'),
 run AS (SELECT station, macro, ware, used, n * w AS units, seconds, amount, CASE WHEN (station + macro + ware) % 3 = 0 THEN 1 + ware::DOUBLE / 128 WHEN (station + macro) % 4 = 0 THEN CASE WHEN work > 0 THEN 1 + work * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1.25::DOUBLE - 1) / (SELECT min(work) FROM known k WHERE k.macro = known.macro AND k.work > 0))) ELSE 1.25::DOUBLE END ELSE 1.0::DOUBLE END AS efficiency FROM modules JOIN known USING (macro)),
 outp AS (SELECT station, ware, sum(floor(amount * efficiency) / seconds * 3600 * units) AS rate FROM run GROUP BY ALL),
 inp AS (SELECT station, input AS ware, sum(needed / seconds * 3600 * units) AS rate FROM run JOIN inputs USING (ware, used) WHERE used <> 'processing' GROUP BY ALL),
 force AS (SELECT 1 + c_custkey % stations AS station, c_mktsegment AS race, sum(c_nationkey) AS amount FROM customer, n GROUP BY ALL),
 heads AS (SELECT station, race, floor((CASE WHEN station % 3 = 0 THEN 500.0::DOUBLE ELSE total END) * (amount / total)) AS heads FROM (SELECT *, sum(amount) OVER (PARTITION BY station)::DOUBLE AS total FROM force) WHERE total > 0),
 ate AS (SELECT station, f.ware, f.needed::DOUBLE / 20 / 600 * 3600 * heads AS rate FROM heads JOIN (SELECT unnest([1, 2, 8]) AS ware, unnest(['default', 'default', 'BUILDING']) AS used, unnest([9, 5, 7]) AS needed) f ON used = CASE WHEN race = 'BUILDING' THEN 'BUILDING' ELSE 'default' END WHERE heads > 0),
 food AS (SELECT station, ware, sum(rate) AS rate, sum(floor(rate * 4)) AS buffer FROM ate GROUP BY ALL),
 tags AS (SELECT s_suppkey AS station, 'k' || tag AS transport, CASE WHEN s_suppkey % 2 = 0 THEN 'k' || (tag // 2 * 2) ELSE 'k' || tag END AS grp FROM supplier, (SELECT unnest([0, 1, 2]) AS tag)),
 caps AS (SELECT station, grp, sum(1000000.0::DOUBLE * (1 + station % 5)) AS cap FROM (SELECT DISTINCT station, grp FROM tags) WHERE station % 7 <> 0 GROUP BY ALL)"""


def stations(spark, sf_dir) -> dict:
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    goods = p.select((F.col("p_partkey") % 30).alias("ware")).distinct()
    method = F.when(F.col("first") % 3 == 0, "default").when(F.col("first") % 3 == 1, "other").otherwise("processing")
    d = {
        "wares": goods.filter("ware % 29 <> 0").select("ware", F.concat(F.lit("k"), F.col("ware") % 4).alias("transport"), (1.0 + F.col("ware") % 5).alias("volume"), (F.col("ware") % 11 != 0).alias("economy")),
        "recipes": goods.select("ware", F.explode(F.array(*map(F.lit, ("default", "other", "processing")))).alias("method")).filter("method = 'default' OR (method = 'other' AND ware % 2 = 0) OR (method = 'processing' AND ware % 5 = 0)")
        .select("ware", "method", (60.0 + F.col("ware")).alias("seconds"), (10.0 + F.col("ware")).alias("amount"), ((F.col("ware") % 4).cast("double") / 10).alias("work")),
        "makes": p.groupBy((F.col("p_size") % 20).alias("macro"), (F.col("p_partkey") % 30).alias("ware")).agg(F.min("p_partkey").alias("first")).select("macro", "ware", method.alias("method"), F.lit(2.0).alias("scale"), F.lit(0.5).alias("weight")),
        "modules": table(spark, sf_dir, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_suppkey").alias("station"), (F.col("p_size") % 20).alias("macro")).agg(F.count("*").alias("n")),
        "tags": s.select(F.col("s_suppkey").alias("station"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tag")).select("station", F.when(F.col("station") % 2 == 0, F.floor(F.col("tag") / 2)).otherwise(F.col("tag")).alias("store"), F.concat(F.lit("k"), "tag").alias("tag")),
    }
    d["inputs"] = d["recipes"].select("ware", F.col("method").alias("used"), ((F.col("ware") + 7) % 30).alias("input"), (2.0 + F.col("ware") % 3).alias("needed"))
    at = d["modules"].join(d["makes"], "macro").filter("(station + macro + ware) % 3 = 0").select("station", "macro", "ware", (1 + F.col("ware").cast("double") / 128).alias("told"))
    of_all = d["modules"].filter("(station + macro) % 4 = 0").select("station", "macro", F.lit(1.25).alias("of_all"))
    d["run"] = S.running(d["modules"], d["makes"], d["recipes"], at, of_all, s.select(F.col("s_suppkey").alias("station"), F.lit(1.0).alias("light")))
    number = s.agg(F.count("*").alias("stations"))  # a row
    force = table(spark, sf_dir, "customer").crossJoin(F.broadcast(number)).groupBy((1 + F.col("c_custkey") % F.col("stations")).alias("station"), F.col("c_mktsegment").alias("race")).agg(F.sum("c_nationkey").alias("amount"))
    places = force.select("station").distinct().filter("station % 3 = 0").withColumn("places", F.lit(500.0))
    meals = spark.createDataFrame([("work", "default", 600.0, 20.0), ("work", "BUILDING", 600.0, 20.0)], "need string, method string, seconds double, amount double")
    dishes = spark.createDataFrame([("default", 1, 9.0), ("default", 2, 5.0), ("BUILDING", 8, 7.0)], "used string, ware long, needed double")
    d["food"] = S.rations(force, places, meals, dishes)
    return d


@query(f"WITH {STATIONS_SQL} SELECT coalesce(o.station, i.station) AS station, coalesce(o.ware, i.ware) AS ware, ROUND(o.rate, 3) AS made, ROUND(i.rate, 3) AS used FROM outp o FULL JOIN inp i ON o.station = i.station AND o.ware = i.ware")
def dom31_throughput(spark, sf_dir):
    d = stations(spark, sf_dir)
    made, used = S.output(d["run"]).withColumnRenamed("rate", "made"), S.intake(d["run"], d["inputs"]).withColumnRenamed("rate", "used")
    return made.join(used, ["station", "ware"], "full_outer").select("station", "ware", r("made", 3).alias("made"), r("used", 3).alias("used"))


@query(f"WITH {STATIONS_SQL} SELECT station, ware, ROUND(rate, 4) AS rate, buffer::BIGINT AS buffer FROM food")
def dom31_rations(spark, sf_dir):
    return stations(spark, sf_dir)["food"].withColumn("rate", r("rate"))


@query(f"WITH {STATIONS_SQL} SELECT station AS owner, transport AS tag, grp FROM tags")
def gr07_tag_groups(spark, sf_dir):
    checkpoints(spark)
    return G.tag_groups(stations(spark, sf_dir)["tags"].withColumnRenamed("station", "owner"))


def pools(spark, sf_dir):
    checkpoints(spark)
    d = stations(spark, sf_dir)
    groups = G.tag_groups(d["tags"].withColumnRenamed("station", "owner")).select(F.col("owner").alias("station"), F.col("tag").alias("transport"), "grp")
    caps = groups.select("station", "grp").distinct().filter("station % 7 <> 0").withColumn("cap", 1000000.0 * (1 + F.col("station") % 5))
    return d, groups, caps


ALLOCATION_SQL = f"""{STATIONS_SQL}, flow AS (SELECT station, ware, o.rate AS o, i.rate AS i, f.rate AS f, coalesce(buffer, 0) AS buffer FROM outp o FULL JOIN (SELECT * FROM inp WHERE ware NOT IN (SELECT ware FROM wares WHERE NOT economy)) i USING (station, ware) FULL JOIN food f USING (station, ware) WHERE station IN (SELECT station FROM caps)),
 p AS (SELECT flow.*, transport, grp, cap, coalesce(volume, 1) AS volume, CASE WHEN i IS NOT NULL AND (o IS NULL OR i > o) THEN 'input' WHEN o IS NOT NULL THEN 'output' ELSE 'food' END AS role, CASE WHEN i IS NOT NULL AND (o IS NULL OR i > o) THEN i ELSE o END AS thru FROM flow LEFT JOIN wares USING (ware) LEFT JOIN tags USING (station, transport) LEFT JOIN caps USING (station, grp)),
 q AS (SELECT *, sum(thru * volume) OVER w AS need, sum(buffer * volume) OVER w AS kept FROM p WINDOW w AS (PARTITION BY station, grp)),
 computed AS (SELECT station, ware, transport, role, coalesce(thru, f) AS throughput, CASE WHEN thru IS NOT NULL AND need > 0 THEN thru * (coalesce(cap, 0) - kept) / need ELSE 0 END + buffer AS max_units FROM q)"""


@query(f"WITH {ALLOCATION_SQL} SELECT station, ware, transport, role, ROUND(throughput, 3) AS throughput, ROUND(max_units, 2) AS max_units FROM computed")
def dom31_allocation(spark, sf_dir):
    d, groups, caps = pools(spark, sf_dir)
    found = S.allocate(S.output(d["run"]), S.intake(d["run"], d["inputs"]), d["food"], d["wares"], groups, caps)
    return found.withColumns({"throughput": r("throughput", 3), "max_units": r("max_units", 2)})


TRADED_SQL = "traded AS (SELECT DISTINCT l_suppkey AS station, l_partkey % 30 AS ware FROM lineitem)"


@query(f"WITH {STATIONS_SQL}, {TRADED_SQL} SELECT station, ware, ROUND(cap / count(*) OVER (PARTITION BY station, grp) / volume, 2) AS max_units FROM traded JOIN wares USING (ware) JOIN tags USING (station, transport) JOIN caps USING (station, grp)")
def dom31_equal_shares(spark, sf_dir):
    d, groups, caps = pools(spark, sf_dir)
    traded = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station"), (F.col("l_partkey") % 30).alias("ware"))
    return S.equal_shares(traded, d["wares"], groups, caps).withColumn("max_units", r("max_units", 2))


@query("""WITH x AS (SELECT l_suppkey AS station, l_partkey AS ware, l_quantity AS amount, l_returnflag AS flag FROM lineitem)
 SELECT station, ware, sum(amount) AS max_units FROM x WHERE (station, ware) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_linenumber = 7) GROUP BY ALL""")
def dom31_proxy(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_partkey").alias("ware"), F.col("l_quantity").alias("amount"), "l_returnflag", "l_linenumber")
    return S.proxy(l.filter("l_returnflag = 'A'"), l.filter("l_returnflag = 'N'"), l.filter("l_returnflag = 'R'"), l.filter("l_linenumber = 7"))


@query("""WITH u AS (SELECT l_suppkey AS station, CASE WHEN contains(p_type, 'BRASS') THEN 'drone' WHEN contains(p_type, 'STEEL') THEN 'missile' WHEN contains(p_type, 'ANODIZED') THEN 'mine' ELSE 'other' END AS category, sum(l_quantity) AS amount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
 h AS (SELECT ps AS station, sum(storage) + 10 * sum(modules) AS capacity FROM (SELECT s_suppkey AS ps, s_nationkey * 10 AS storage, s_suppkey % 3 AS modules FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT s_suppkey, 5, 1 FROM supplier WHERE s_suppkey % 4 = 1) GROUP BY 1)
 SELECT station, category, amount, capacity FROM u LEFT JOIN h USING (station)""")
def dom32_munition(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "station")
    stock = table(spark, sf_dir, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("station"), F.col("p_type").alias("macro"), F.col("l_quantity").alias("amount"))
    holds = s.filter("station % 10 <> 0").select("station", (F.col("s_nationkey") * 10).alias("storage"), (F.col("station") % 3).alias("modules"))
    holds = holds.unionByName(s.filter("station % 4 = 1").select("station", F.lit(5).alias("storage"), F.lit(1).alias("modules")))
    return S.munition(stock, holds, [("BRASS", "drone"), ("STEEL", "missile"), ("ANODIZED", "mine")])


@query(f"""WITH {ALLOCATION_SQL}, held AS (SELECT l_suppkey AS station, l_partkey % 30 AS ware, sum(l_quantity) * 500 AS stock, max(l_discount) AS m FROM lineitem GROUP BY ALL),
 lim AS (SELECT station, ware, stock, coalesce(CASE WHEN (station + ware) % 6 = 0 THEN 50000.0::DOUBLE END, CASE WHEN (station + ware) % 4 = 0 THEN 80000.0::DOUBLE END, CASE WHEN role <> 'food' THEN max_units END) AS cap FROM held LEFT JOIN computed USING (station, ware))
 SELECT station, ware, stock, ROUND(cap, 2) AS cap, coalesce(cap > 0 AND stock >= 0.95::DOUBLE * cap, false) AS blocked FROM lim""")
def dom30_blocked(spark, sf_dir):
    d, groups, caps = pools(spark, sf_dir)
    sized = S.allocate(S.output(d["run"]), S.intake(d["run"], d["inputs"]), d["food"], d["wares"], groups, caps).select("station", "ware", "max_units", F.when(F.col("role") == "food", "proxy").otherwise("computed").alias("source"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station"), (F.col("l_partkey") % 30).alias("ware")).agg((F.sum("l_quantity") * 500).alias("stock"))
    place = F.col("station") + F.col("ware")
    cap = S.limit(F.when(place % 6 == 0, 50000.0), F.when(place % 4 == 0, 80000.0), F.col("max_units"), F.col("source"))
    out = held.join(sized, ["station", "ware"], "left").withColumn("cap", cap)
    return out.select("station", "ware", "stock", r("cap", 2).alias("cap"), S.blocked(F.col("stock"), F.col("cap")).alias("blocked"))
