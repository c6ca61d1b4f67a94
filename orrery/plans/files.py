"""Queries of game files and the map: documents, paths and control points are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import equipment as E
from orrery.operators import galaxy as G
from orrery.sources import game_files as K
from orrery.sources import patches as P
from orrery.sources import snapshot_tables as T
from orrery.sources import snapshot_xml as X

from .relational import query, r
from .roles import seconds, table
from .world import folder

#: Wares of a document.
BLOCK = 100


def merged(spark, sf_dir):
    """Documents of parts as wares, each with two files of patches, written as XML, read and patched."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumns({"doc": F.floor(k / BLOCK).cast("long"), "price": F.round(F.col("p_retailprice") * 100).cast("long")})
    form = F.format_string
    made = form('<production method="default" time="%d" amount="%d"><primary>', size + 10, k % 5 + 1)
    ware = F.concat(form('<ware id="w%d" name="N%d" volume="%d"><price min="%d" average="%d" max="%d"/>', k, k, size, F.col("price") - 50, F.col("price"), F.col("price") + 50), made, F.when(k % 3 != 0, form('<ware ware="w%d" amount="%d"/>', k + 1, size)).otherwise(""), F.when(k % 3 == 2, form('<ware ware="w%d" amount="2"/>', k + 2)).otherwise(""), F.lit("</primary>"), F.when(k % 4 == 0, '<effects><effect type="work" product="0.5"/></effects>').otherwise(""), F.lit("</production></ware>"))
    at = form("/wares/ware[@id='w%d']", k)
    first = F.when(k % 7 == 1, F.concat(F.lit('<replace sel="'), at, form('/price/@average">%d</replace>', F.col("price") + 7))).when(k % 7 == 2, F.concat(F.lit('<remove sel="'), at, F.lit('"/>'))).when(k % 7 == 3, F.concat(F.lit('<add sel="'), at, form('"><production method="new" time="1" amount="1"><primary><ware ware="x%d" amount="9"/></primary></production></add>', k)))
    second = F.when(k % 7 == 2, form('<add sel="/wares"><ware id="w%d" name="Again"/></add>', k)).when(k % 7 == 3, F.concat(F.lit('<replace sel="'), at, form("/production[@method='new']\"><production method=\"newer\" time=\"2\" amount=\"%d\"/></replace>", size))).when(k % 7 == 4, F.concat(F.lit('<add sel="'), at, F.lit('/production[@method=\'default\']/primary"><ware ware="extra" amount="1"/></add>'))).when(k % 14 == 1, F.concat(F.lit('<replace sel="'), at, F.lit('/price/@average">1</replace>')))
    rows = p.select("doc", "p_partkey", F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), x.alias("xml")) for t, x in enumerate((ware, first, second))])).alias("x")).select("doc", "p_partkey", "x.*").filter("xml IS NOT NULL")
    docs = rows.groupBy("doc", "turn").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "xml"))).alias("all"))  # the wares of a document
    root = F.when(F.col("turn") == 0, "wares").otherwise("diff")
    value = F.concat(F.lit("<"), root, F.lit(">"), F.array_join(F.transform("all", lambda x: x["xml"]), ""), F.lit("</"), root, F.lit(">"))
    docs.select("doc", "turn", value.alias("value")).write.partitionBy("doc", "turn").text(path := folder(spark))
    part = lambda name: F.regexp_extract("file", f"/{name}=([0-9]+)/", 1)
    elems = X.elements(spark, path, suffixes=(".txt",)).withColumns({"doc": part("doc"), "turn": part("turn").cast("int")})
    return P.patched(T.kept(elems, f"{path}-elements"))[0]


WARES_SQL = "p AS (SELECT *, p_partkey AS k, round(p_retailprice * 100)::BIGINT AS price FROM part)"


@query(f"WITH {WARES_SQL} SELECT 'w' || k AS ware, CASE WHEN k % 7 = 2 THEN 'Again' ELSE 'N' || k END AS name, CASE WHEN k % 7 <> 2 THEN p_size END::DOUBLE AS volume, CASE WHEN k % 7 <> 2 THEN price - 50 END::DOUBLE AS price_min, CASE WHEN k % 7 <> 2 THEN CASE WHEN k % 14 = 1 THEN 1 WHEN k % 7 = 1 THEN price + 7 ELSE price END END::DOUBLE AS price_avg, CASE WHEN k % 7 <> 2 THEN price + 50 END::DOUBLE AS price_max FROM p")
def ext02_wares(spark, sf_dir):
    return K.wares(merged(spark, sf_dir)).select("ware", "name", "volume", "price_min", "price_avg", "price_max")


@query(f"""WITH {WARES_SQL}, made AS (SELECT k, 'default' AS method, p_size + 10 AS time, k % 5 + 1 AS amount, CASE WHEN k % 4 = 0 THEN 0.5 END AS work_effect FROM p WHERE k % 7 <> 2 UNION ALL SELECT k, 'newer', 2, p_size, NULL FROM p WHERE k % 7 = 3),
 taken AS (SELECT k, 'w' || (k + 1) AS input_ware, p_size AS input_amount FROM p WHERE k % 3 <> 0 UNION ALL SELECT k, 'w' || (k + 2), 2 FROM p WHERE k % 3 = 2 UNION ALL SELECT k, 'extra', 1 FROM p WHERE k % 7 = 4)
 SELECT DISTINCT 'w' || made.k AS ware, method, time::DOUBLE AS time, amount::DOUBLE AS amount, input_ware, input_amount::DOUBLE AS input_amount, work_effect::DOUBLE AS work_effect FROM made LEFT JOIN taken ON taken.k = made.k AND method = 'default'""")
def ext08_recipes(spark, sf_dir):
    return K.recipes(merged(spark, sf_dir))


MAP_SQL = """l AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_quantity::BIGINT AS q FROM lineitem),
 zone AS (SELECT 'zone' || (p_partkey % 40) || '_connection' AS name, arg_max('zm' || (p_partkey % 11), p_partkey) AS macro, arg_max(p_size * 1000.0, p_partkey) AS x, arg_max(p_partkey * -10.0, p_partkey) AS z FROM part WHERE p_partkey % 40 < 32 GROUP BY 1),
 gate AS (SELECT 'zm' || (s_suppkey % 9) AS macro, 'gate' || (s_suppkey % 4) AS name, s_nationkey * 1.0 AS x, s_suppkey * 2.0 AS z, s_suppkey AS ord FROM supplier),
 ends AS (SELECT ord, n, 'cluster_' || (s % 12) || '_sector00' || (p % 3) || '_macro' AS a, 'cluster_' || (s % 5) || '_sector00' || (q % 3) || '_macro' AS b, 'zone' || (p % 40) || '_connection' AS za, 'zone' || (q % 40) || '_connection' AS zb, 'gate' || (p % 6) AS ga, CASE WHEN n = 2 THEN 'gate' || (q % 6) END AS gb FROM (SELECT * FROM l WHERE n IN (1, 2) QUALIFY row_number() OVER (PARTITION BY ord ORDER BY p, s, q) = 1)),
 spot AS (SELECT e.*, coalesce(x.x + coalesce(gx.x, fx.x, 0), 0) AS ax, coalesce(x.z + coalesce(gx.z, fx.z, 0), 0) AS az, coalesce(y.x + coalesce(gy.x, fy.x, 0), 0) AS bx, coalesce(y.z + coalesce(gy.z, fy.z, 0), 0) AS bz FROM ends e LEFT JOIN zone x ON x.name = za LEFT JOIN zone y ON y.name = zb
  LEFT JOIN (SELECT macro, name, arg_max(x, ord) AS x, arg_max(z, ord) AS z FROM gate GROUP BY ALL) gx ON gx.macro = x.macro AND gx.name = ga LEFT JOIN (SELECT macro, name, arg_max(x, ord) AS x, arg_max(z, ord) AS z FROM gate GROUP BY ALL) gy ON gy.macro = y.macro AND gy.name = gb
  LEFT JOIN (SELECT macro, arg_min(x, ord) AS x, arg_min(z, ord) AS z FROM gate GROUP BY ALL) fx ON fx.macro = x.macro LEFT JOIN (SELECT macro, arg_min(x, ord) AS x, arg_min(z, ord) AS z FROM gate GROUP BY ALL) fy ON fy.macro = y.macro WHERE a <> b)"""


def gate_links(spark, sf_dir):
    p, s, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    zones = p.filter("p_partkey % 40 < 32").select(F.concat(F.lit("Zone"), F.col("p_partkey") % 40, F.lit("_connection")).alias("name"), F.concat(F.lit("ZM"), F.col("p_partkey") % 11).alias("macro"), (F.col("p_size") * 1000.0).alias("x"), (F.col("p_partkey") * -10.0).alias("z"), F.col("p_partkey").alias("ord"))
    gates = s.select(F.concat(F.lit("zm"), F.col("s_suppkey") % 9).alias("macro"), F.concat(F.lit("Gate"), F.col("s_suppkey") % 4).alias("name"), (F.col("s_nationkey") * 1.0).alias("x"), (F.col("s_suppkey") * 2.0).alias("z"), F.col("s_suppkey").alias("ord"))
    one = l.filter("l_linenumber IN (1, 2)").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").alias("n")).alias("v")).groupBy("ord").agg(F.min("v").alias("v")).select("ord", "v.*")
    path = lambda c, t, z, g: F.concat(F.lit("../Cluster_"), F.col("s") % c, F.lit("_connection/Cluster_"), F.col("s") % c, F.lit("_Sector00"), F.col(t) % 3, F.lit("_connection/Zone"), F.col(z) % 40, F.lit("_connection"), g)
    rows = one.withColumns({"a_path": path(12, "p", "p", F.concat(F.lit("/Gate"), F.col("p") % 6)), "b_path": path(5, "q", "q", F.lit("")), "a_gate": F.lit(None).cast("string"), "b_gate": F.concat(F.lit("GATE"), F.col("q") % 6)})
    return G.links(rows.filter("n = 1"), rows.filter("n = 2"), zones, gates)


@query(f"""WITH {MAP_SQL}, back AS (SELECT DISTINCT b AS a, a AS b FROM spot WHERE n = 2), one AS (SELECT n, ord, least(spot.a, spot.b) AS sector_a, greatest(spot.a, spot.b) AS sector_b, spot.b < spot.a AS turned, ax, az, bx, bz, CASE WHEN n = 2 AND back.a IS NULL THEN spot.b END AS oneway FROM spot LEFT JOIN back ON back.a = spot.a AND back.b = spot.b)
 SELECT sector_a, sector_b, CASE WHEN turned THEN bx ELSE ax END::DOUBLE AS ax, CASE WHEN turned THEN bz ELSE az END::DOUBLE AS az, CASE WHEN turned THEN ax ELSE bx END::DOUBLE AS bx, CASE WHEN turned THEN az ELSE bz END::DOUBLE AS bz, oneway FROM one QUALIFY row_number() OVER (PARTITION BY sector_a, sector_b ORDER BY n, ord) = 1""")
def ext06_gates(spark, sf_dir):
    return gate_links(spark, sf_dir)


@query(f"WITH {MAP_SQL} SELECT count(DISTINCT (a, b)) AS n, count(DISTINCT (a, b)) FILTER (NOT EXISTS (SELECT 1 FROM spot AS o WHERE o.n = 2 AND o.a = spot.b AND o.b = spot.a)) AS oneway FROM spot WHERE n = 2")
def gr09_one_way_edges(spark, sf_dir):
    """How many directed highways there are, and how many have no way back."""
    p = table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")).agg(F.min(F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"))).alias("v")).select("v.*")
    edge = p.select(F.concat(F.lit("cluster_"), F.col("s") % 12, F.lit("_sector00"), F.col("p") % 3, F.lit("_macro")).alias("a"), F.concat(F.lit("cluster_"), F.col("s") % 5, F.lit("_sector00"), F.col("q") % 3, F.lit("_macro")).alias("b")).filter("a <> b").distinct()
    alone = edge.join(edge.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    return edge.agg(F.count("*").alias("n")).join(alone.agg(F.count("*").alias("oneway")), F.lit(True))


POINT_SQL = "c AS (SELECT user_id AS track, event_id AS k, value AS x, (epoch_us(ts) // 1000000 % 1000)::DOUBLE AS z, sin(event_id) AS tx, cos(event_id) AS tz, value / 3 AS inlength, value / 4 AS outlength FROM events WHERE event_type = 'view' OR event_id % 3 = 0)"


@query(f"""WITH {POINT_SQL}, s AS (SELECT *, lead(x) OVER w AS x1, lead(z) OVER w AS z1, lead(tx) OVER w AS tx1, lead(tz) OVER w AS tz1, lead(inlength) OVER w AS in1, row_number() OVER w - 1 AS span FROM c WINDOW w AS (PARTITION BY track ORDER BY k)), i AS (SELECT *, unnest(generate_series(CASE WHEN span = 0 THEN 0 ELSE 1 END, 16)) AS i FROM s WHERE x1 IS NOT NULL), t AS (SELECT *, i / 16.0::DOUBLE AS t FROM i)
 SELECT track, span * 16 + i AS n, ROUND(pow(1 - t, 3) * x + 3 * pow(1 - t, 2) * t * (x + tx * outlength) + 3 * (1 - t) * t * t * (x1 - tx1 * in1) + pow(t, 3) * x1, 4) AS x, ROUND(pow(1 - t, 3) * z + 3 * pow(1 - t, 2) * t * (z + tz * outlength) + 3 * (1 - t) * t * t * (z1 - tz1 * in1) + pow(t, 3) * z1, 4) AS z FROM t""")
def ext05_tracks(spark, sf_dir):
    k = F.col("event_id")
    c = table(spark, sf_dir, "events").filter("event_type = 'view' OR event_id % 3 = 0").select(F.col("user_id").alias("track"), k.alias("k"), F.col("value").alias("x"), (F.floor(seconds("ts")) % 1000).cast("double").alias("z"), F.sin(k).alias("tx"), F.cos(k).alias("tz"), (F.col("value") / 3).alias("inlength"), (F.col("value") / 4).alias("outlength"))
    return G.tracks(c).select("track", F.col("n").cast("long").alias("n"), r("x").alias("x"), r("z").alias("z"))


@query("WITH s AS (SELECT s_suppkey AS sector, s_nationkey AS cluster FROM supplier), l AS (SELECT n_nationkey AS macro, n_regionkey * 0.3 AS sun FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000, s_suppkey * 0.1 FROM supplier WHERE s_suppkey % 4 = 0) SELECT sector + 1000 AS sector, cluster, coalesce(a.sun, b.sun, 1.0)::DOUBLE AS sunlight FROM s LEFT JOIN l a ON a.macro = sector + 1000 LEFT JOIN l b ON b.macro = cluster")
def ext04_sunlight(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    light = n.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("long").alias("macro"), (F.col("n_regionkey") * 0.3).alias("sunlight")).unionByName(s.filter("s_suppkey % 4 = 0").select((F.col("s_suppkey") + 1000).alias("macro"), (F.col("s_suppkey") * 0.1).alias("sunlight")))
    return G.sunlit(s.select((F.col("s_suppkey") + 1000).alias("sector"), F.col("s_nationkey").cast("long").alias("cluster")), light)


def library(spark, sf_dir, kind):
    """The nodes of game files that parts stand in, one file of each kind for a block of parts, written as XML and read."""
    k, size, form = F.col("p_partkey"), F.col("p_size"), F.format_string
    macro = lambda name, cls, *inner: F.concat(form(f'<macro name="{name}" class="{cls}"><properties>', k), *inner, F.lit("</properties></macro>"))
    maker = F.when(k % 3 == 0, form('<production><queue ware="w%d"/><queue><item ware="v%d" method="new"/><item ware="w%d"/></queue></production>', k % 50, k % 40, k % 50)).when(k % 3 == 1, form('<production wares="a%d b%d"/>', k % 20, k % 30)).otherwise(form('<products><ware ware="p%d" amount="%d"/></products>', k % 20, size))
    xml = {
        "factions": F.concat(form('<faction id="f%d" name="Name %d" shortname="S%d"%s><color ref="r%d"/></faction>', k, k, k % 100, F.when(k % 2 == 0, ' primaryrace="x"').otherwise(""), k % 60), F.when(k % 60 == k, form('<mapping id="r%d" ref="c%d"/>', k, k % 45)).otherwise(""), F.when(k % 40 == k, form('<color id="c%d" r="%d" g="%d" b="255"/>', k, k, k * 5 % 256)).otherwise("")),
        "names": form('<dataset macro="M_%d"><properties><identification name="N%d" description="D"/></properties></dataset>', k % 500, k),
        "modules": macro("Mod_%d", "production", maker, F.when(k % 4 == 0, form('<workforce max="%d"/>', size)).otherwise("")),
        "ships": F.concat(form('<macro name="Ship_%d" class="%s"><properties><identification name="%s" makerrace="arg"/><hull max="%d"/><physics mass="%d"><drag forward="%d"/></physics>%s</properties><connections><connection ref="a"><macro ref="Store_%d"/></connection><connection ref="b"><macro ref="store_%d"/></connection></connections></macro>', k, F.when(k % 5 == 4, "ship_xxl").when(k % 2 == 0, "ship_m").otherwise("ship_l"), form("Ship %d", k), size * 100, size * 3, size, F.when(k % 3 == 0, form('<cargo max="%d" tags="own"/>', size)).otherwise(""), k, k + 1)),
        "storage": macro("Store_%d", "storage", F.when(k % 4 != 0, form('<cargo max="%d" tags="%s"/>', size * 10, F.when(k % 2 == 0, "solid liquid").otherwise("container solid"))).otherwise("")),
        "yields": form('<yields><yield id="l%d"><ware id="w%d" yield="%d"/></yield></yields>', k % 4, k, size),
        "weapons": macro("Weapon_%d_s_x", "weapon", form('<bullet class="Bullet_%d"/><heat overheat="%d"/>', k % 300, size)),
        "bullets": macro("bullet_%d", "bullet", form('<bullet speed="%d" lifetime="2"/><damage value="%d"/>', size, k % 90), F.when(k % 2 == 0, form('<heat value="%d"/><reload rate="4"/>', size)).otherwise("")),
        "mods": form('<stat%d ware="mod_%d" quality="%d" min="1.5"><bonus chance="%s" max="%d"><heat min="2" max="3"/>%s</bonus></stat%d>', k % 3, k, k % 3 + 1, F.when(k % 2 == 0, "1").otherwise("0.5"), k % 3, F.when(k % 4 < 2, '<speed weight="0.5"/>').otherwise(""), k % 3),
        "engines": F.concat(form('<macro name="Engine_%d_%s_%s_mk%d_macro" class="%s"><properties>', k, F.element_at(F.array(*map(F.lit, ("s", "m", "l", "xl", "y"))), (k % 5 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("allround", "travel", "z"))), (k % 3 + 1).cast("int")), k % 2 + 1, F.when(k % 11 == 0, "fx").otherwise("engine")), F.when(k % 7 != 0, form('<thrust forward="%d"/><boost duration="3" thrust="%d"/>', size, k % 9)).otherwise(""), F.when(k % 4 == 0, form('<travel charge="2" thrust="%d"/>', size)).otherwise(""), F.lit("</properties></macro>")),
        "thrusters": form('<macro name="Thruster_gen_%s_%d_macro" class="engine"><properties><thrust strafe="%d" pitch="%d" yaw="3"/></properties></macro>', F.element_at(F.array(*map(F.lit, ("s", "m", "l"))), (k % 3 + 1).cast("int")), k, k, size),
        "bodies": F.concat(form('<macro name="Ship_%d" class="ship_m"><properties><physics mass="%d">', k, size), F.when(k % 3 != 0, '<inertia pitch="2" yaw="4"/>').otherwise(""), F.when(k % 5 != 0, form('<drag forward="%d" pitch="2"/>', size)).otherwise(""), F.lit("</physics></properties></macro>")),
        "shields": form('<macro name="Shield_x_%s_%d" class="shieldgenerator"><properties><recharge max="%d" rate="%d"/></properties></macro>', F.when(k % 2 == 0, "m").otherwise("l"), k, size * 10, k % 4),
        "wares": form('<ware id="mod_%d" name="Long %d (of it)"%s/>', k, k, F.when(k % 2 == 0, form(' shortname=" S%d "', k)).otherwise("")),
    }
    docs = table(spark, sf_dir, "part").select(F.floor(k / BLOCK).cast("long").alias("doc"), F.struct("p_partkey", xml[kind].alias("xml")).alias("x")).groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("all"))  # the parts of a document
    docs.select("doc", F.concat(F.lit("<lib>"), F.array_join(F.transform("all", lambda x: x["xml"]), ""), F.lit("</lib>")).alias("value")).write.partitionBy("doc").text(path := folder(spark))
    elems = X.elements(spark, path, suffixes=(".txt",)).withColumns({"doc": F.lpad(F.regexp_extract("file", "/doc=([0-9]+)/", 1), 9, "0"), "turn": F.lit(0)})
    return P.stepped(T.kept(elems, f"{path}-elements")).withColumn("place", F.col("line"))


@query("SELECT 'f' || p_partkey AS faction, 'S' || p_partkey % 100 AS shortname, 'Name ' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'x' END AS race, CASE WHEN p_partkey % 60 % 45 < 40 THEN '#' || printf('%02x', p_partkey % 60 % 45) || printf('%02x', p_partkey % 60 % 45 * 5 % 256) || 'ff' END AS colour FROM part")
def ext01_factions(spark, sf_dir):
    return K.factions(library(spark, sf_dir, "factions"))


@query("SELECT 'm_' || p_partkey % 500 AS macro, 'N' || max(p_partkey) AS name, 'D' AS description FROM part GROUP BY p_partkey % 500")
def ext03_map_names(spark, sf_dir):
    return K.map_names(library(spark, sf_dir, "names"))


@query("""WITH x AS (SELECT p_partkey AS k, p_size, unnest(CASE p_partkey % 3 WHEN 0 THEN ['w' || p_partkey % 50, 'v' || p_partkey % 40] WHEN 1 THEN ['a' || p_partkey % 20, 'b' || p_partkey % 30] ELSE ['p' || p_partkey % 20] END) AS ware FROM part)
 SELECT 'mod_' || k AS macro, ware, CASE WHEN k % 3 = 2 THEN 'processing' WHEN ware[1] = 'v' THEN 'new' ELSE 'default' END AS method, CASE WHEN k % 3 = 2 THEN p_size ELSE 1 END::DOUBLE AS scale, CASE WHEN k % 4 = 0 THEN p_size END::DOUBLE AS workers FROM x""")
def ext07_products(spark, sf_dir):
    return K.products(library(spark, sf_dir, "modules"))


@query("""WITH st AS (SELECT p_partkey AS k, p_size * 10 AS most, CASE WHEN p_partkey % 2 = 0 THEN ['liquid', 'solid'] ELSE ['container', 'solid'] END AS tags FROM part WHERE p_partkey % 4 <> 0), h AS (SELECT p_partkey AS k, sum(most) AS held, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ' ') AS tags FROM part JOIN st ON st.k = p_partkey OR st.k = p_partkey + 1 GROUP BY p_partkey)
 SELECT 'ship_' || p_partkey AS macro, 'Ship ' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE 'L' END AS size, (p_size * 100)::DOUBLE AS hull, (p_size * 3)::DOUBLE AS mass, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE held END::DOUBLE AS cargo, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE tags END AS cargo_tags, p_size::DOUBLE AS drag FROM part LEFT JOIN h ON h.k = p_partkey WHERE p_partkey % 5 <> 4""")
def ext12_ships(spark, sf_dir):
    return K.ships(library(spark, sf_dir, "ships"), library(spark, sf_dir, "storage")).select("macro", "name", "size", "hull", "mass", "cargo", "cargo_tags", "drag")


@query("SELECT 'l' || p_partkey % 4 AS level, 'w' || p_partkey AS ware, p_size::DOUBLE AS capacity, 0.0::DOUBLE AS respawn_min FROM part")
def ext13_region_yields(spark, sf_dir):
    return K.region_yields(library(spark, sf_dir, "yields"))


@query("SELECT 'weapon_' || a.p_partkey || '_s_x' AS macro, 'S' AS size, 'bullet_' || a.p_partkey % 300 AS bullet, a.p_size::DOUBLE AS overheat, b.p_size::DOUBLE AS speed, 1.0::DOUBLE AS amount, (b.p_partkey % 90)::DOUBLE AS dmg, CASE WHEN b.p_partkey % 2 = 0 THEN b.p_size ELSE 0 END::DOUBLE AS heat, CASE WHEN b.p_partkey % 2 = 0 THEN 4 END::DOUBLE AS reload_rate FROM part a JOIN part b ON b.p_partkey = a.p_partkey % 300")
def ext15_weapons(spark, sf_dir):
    return K.weapons(library(spark, sf_dir, "weapons"), library(spark, sf_dir, "bullets")).select("macro", "size", "bullet", "overheat", "speed", "amount", "dmg", "heat", "reload_rate")


@query("SELECT 'mod_' || p_partkey AS ware, 'stat' || p_partkey % 3 AS stat, (p_partkey % 3 + 1)::INT AS quality, 1.5::DOUBLE AS min, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0.5 END::DOUBLE AS chance, p_partkey % 2 = 0 AND CASE WHEN p_partkey % 4 < 2 THEN 2 ELSE 1 END <= p_partkey % 3 AS forced, CASE WHEN p_partkey % 4 < 2 THEN 'heat,speed' ELSE 'heat' END AS bonuses, CASE WHEN p_partkey % 2 = 0 THEN 'S' || p_partkey ELSE 'Long ' || p_partkey END AS name FROM part")
def ext16_mods(spark, sf_dir):
    names = K.mod_names(library(spark, sf_dir, "wares"))
    out = K.equipment_mods(library(spark, sf_dir, "mods")).join(names, "ware", "left")
    return out.select("ware", "stat", "quality", "min", "chance", "forced", F.array_join(F.transform("bonuses", lambda b: b["stat"]), ",").alias("bonuses"), "name")


@query("""SELECT 'engine_' || p_partkey || '_' || ['s', 'm', 'l', 'xl', 'y'][p_partkey % 5 + 1] || '_' || ['allround', 'travel', 'z'][p_partkey % 3 + 1] || '_mk' || (p_partkey % 2 + 1) || '_macro' AS macro, ['s', 'm', 'l', 'xl', NULL][p_partkey % 5 + 1] AS size, ['allround', 'travel', NULL][p_partkey % 3 + 1] AS type, (p_partkey % 2 + 1)::INT AS mk, p_size::DOUBLE AS forward, 0.0::DOUBLE AS reverse, (p_partkey % 9)::DOUBLE AS boost_thrust,
 CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 0 END::DOUBLE AS travel_thrust FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0""")
def ext18_engines(spark, sf_dir):
    return K.engines(library(spark, sf_dir, "engines")).select("macro", "size", "type", "mk", "forward", "reverse", "boost_thrust", "travel_thrust")


@query("SELECT ['s', 'm', 'l'][p_partkey % 3 + 1] AS size, p_partkey::DOUBLE AS strafe, p_size::DOUBLE AS pitch, 3.0::DOUBLE AS yaw, 0.0::DOUBLE AS roll FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) = 1")
def ext18_thrusters(spark, sf_dir):
    return K.thrusters(library(spark, sf_dir, "thrusters"))


@query("SELECT 'ship_' || p_partkey AS macro, 'ship_' || p_partkey AS name, 'm' AS size, p_size::DOUBLE AS mass, CASE WHEN p_partkey % 3 <> 0 THEN 2 ELSE 1 END::DOUBLE AS inertia_pitch, CASE WHEN p_partkey % 3 <> 0 THEN 4 ELSE 1 END::DOUBLE AS inertia_yaw, 1.0::DOUBLE AS inertia_roll, p_size::DOUBLE AS drag_forward, 1.0::DOUBLE AS drag_reverse, 2.0::DOUBLE AS drag_pitch FROM part WHERE p_partkey % 5 <> 0")
def ext18_bodies(spark, sf_dir):
    return K.bodies(library(spark, sf_dir, "bodies")).select("macro", "name", "size", "mass", "inertia_pitch", "inertia_yaw", "inertia_roll", "drag_forward", "drag_reverse", "drag_pitch")


@query("SELECT 'shield_x_' || CASE WHEN p_partkey % 2 = 0 THEN 'm' ELSE 'l' END || '_' || p_partkey AS macro, CASE WHEN p_partkey % 2 = 0 THEN 'm' ELSE 'l' END AS size, (p_size * 10)::DOUBLE AS capacity, (p_partkey % 4)::DOUBLE AS rate, 0.0::DOUBLE AS delay FROM part")
def ext18_shields(spark, sf_dir):
    return K.shields(library(spark, sf_dir, "shields"))


MODS = {"weapon": ("damage", "reload", "chargetime", "cooling"), "engine": ("forwardthrust", "travelchargetime", "strafeacc", "rotationthrust"), "shield": ("capacity", "rechargerate", "rechargedelay", "capacity"), "ship": ("mass", "radarcloak", "missilecapacity", "regiondamage")}


def fitted_mods(spark, sf_dir, kind):
    """A modification for each part, with bonuses of two stats that are forced on every other one."""
    k, size = F.col("p_partkey"), F.col("p_size")
    stat = lambda c: F.element_at(F.array(*map(F.lit, MODS[kind])), (c % 4 + 1).cast("int"))
    part = lambda c, low, high: F.struct(stat(c).alias("stat"), low.cast("double").alias("min"), high.cast("double").alias("max"), F.lit(1.0).alias("weight"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("mod_"), k).alias("ware"), stat(k).alias("stat"), (size / 50.0).alias("min"), (size / 25.0).alias("max"), (k % 2 == 0).alias("forced"), F.array(part(k + size, F.lit(0.5), F.lit(0.75)), part(k + 1, F.lit(1.25), 1 + size / 100)).alias("bonuses"))


def mods_sql(kind):
    names, less = list(MODS[kind]), [*E.LESS_IS_BETTER[kind]]
    low, high = ("least(lo, hi)", "greatest(lo, hi)") if kind == "weapon" else ("lo", "hi")
    total = "arg_max(v, ord)" if kind == "weapon" else f"CASE WHEN stat IN {E.ADDED} THEN sum(v) ELSE product(v) END"
    return f"""m AS (SELECT 'mod_' || p_partkey AS ware, {names}[p_partkey % 4 + 1] AS stat, p_size / 50.0::DOUBLE AS lo, p_size / 25.0::DOUBLE AS hi, 0 AS ord FROM part UNION ALL SELECT 'mod_' || p_partkey, {names}[(p_partkey + p_size) % 4 + 1], 0.5, 0.75, 1 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'mod_' || p_partkey, {names}[(p_partkey + 1) % 4 + 1], 1.25, 1 + p_size / 100.0::DOUBLE, 2 FROM part WHERE p_partkey % 2 = 0),
 e AS (SELECT ware, stat, {total} AS value FROM (SELECT *, CASE WHEN stat IN (SELECT unnest({less})) THEN {low} ELSE {high} END AS v FROM m) GROUP BY ware, stat)"""


@query(f"WITH {mods_sql('weapon')} SELECT ware, stat, ROUND(value, 6) AS value FROM e")
def dom66_multipliers(spark, sf_dir):
    return E.realised(fitted_mods(spark, sf_dir, "weapon"), "weapon").withColumn("value", r("value", 6))


HANDLING_SQL = f"""WITH {mods_sql('engine')}, g AS (SELECT ['s', 'm', 'l'][p_partkey % 3 + 1] AS size, [NULL, 'allround', 'combat', 'travel'][p_partkey % 4 + 1] AS type, p_partkey % 5 % 3 + 1 AS mk, p_partkey AS macro, p_size * 10.0::DOUBLE AS forward, p_size % 6 * 1.0::DOUBLE AS acc, p_size % 9 * 1.0::DOUBLE AS boost, p_size % 8 * 1.0::DOUBLE AS travel FROM part WHERE p_partkey % 30 <> 1),
 b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY size ORDER BY CASE WHEN type = 'allround' THEN CASE WHEN mk = 1 THEN 0 ELSE 1 END ELSE 2 END, coalesce(type, ''), mk, macro) = 1), s AS (SELECT p_partkey AS ship, ['s', 'm', 'l'][p_partkey % 3 + 1] AS size, p_size % 10 * 1.0::DOUBLE AS mass, p_size % 4 * 1.0::DOUBLE AS drag, CASE WHEN p_partkey % 6 <> 0 THEN 'mod_' || p_partkey END AS ware FROM part),
 f AS (SELECT ware, max(value) FILTER (stat = 'forwardthrust') AS ft, max(value) FILTER (stat = 'travelchargetime') AS tc, max(value) FILTER (stat = 'strafeacc') AS sa, max(value) FILTER (stat = 'rotationthrust') AS ro FROM e GROUP BY ware),
 x AS (SELECT ship, forward * coalesce(ft, 1) AS fw, CASE WHEN mass = 0 THEN 1 ELSE mass END AS mass, nullif(drag, 0) AS drag, acc, boost, travel, coalesce(tc, 1) AS tc, coalesce(sa, 1) AS sa, coalesce(ro, 1) AS ro FROM s JOIN b USING (size) LEFT JOIN f USING (ware))"""


@query(f"""{HANDLING_SQL} SELECT ship, ROUND(fw / drag, 5) AS forward_speed, ROUND(fw / mass, 5) AS forward_accel, ROUND(7.0 / mass * sa, 5) AS strafe_accel, ROUND(fw * boost / drag, 5) AS boost_speed, ROUND(fw * CASE WHEN acc = 0 THEN 1 ELSE acc END / mass, 5) AS boost_accel, ROUND(fw * travel / drag, 5) AS travel_speed, ROUND(4 * tc, 5) AS travel_charge, ROUND(5 * ro / ((coalesce(drag, 0) + 2) / 2), 5) AS turn_rate, ROUND(5 * ro / 1.5, 5) AS turn_accel FROM x""")
def dom68_handling(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    p, one = table(spark, sf_dir, "part"), F.lit(1.0)
    of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    engines = p.filter("p_partkey % 30 <> 1").select(k.alias("macro"), of("s", "m", "l").alias("size"), of(None, "allround", "combat", "travel").alias("type"), (k % 5 % 3 + 1).alias("mk"), (size * 10.0).alias("forward"), one.alias("reverse"), (size % 6 * 1.0).alias("boost_acceleration"), (size % 9 * 1.0).alias("boost_thrust"), one.alias("boost_duration"), (size % 8 * 1.0).alias("travel_thrust"), F.lit(4.0).alias("travel_charge"), one.alias("travel_attack"))
    ships = p.select(k.alias("ship"), of("s", "m", "l").alias("size"), (size % 10 * 1.0).alias("mass"), *[(size % 4 * 1.0).alias(f"drag_{a}") for a in ("forward", "pitch")], *[one.alias(f"drag_{a}") for a in ("reverse", "horizontal", "roll")], F.lit(2.0).alias("drag_yaw"), one.alias("inertia_pitch"), F.lit(2.0).alias("inertia_yaw"), F.when(k % 6 != 0, F.concat(F.lit("mod_"), k)).alias("ware"))
    thrusters = engines.select("size").distinct().withColumns({"strafe": F.lit(7.0), "pitch": F.lit(4.0), "yaw": F.lit(6.0), "roll": one})
    rows = ships.join(E.usual_engine(engines).drop("macro", "type", "mk"), "size").join(thrusters, "size").join(E.effects(E.realised(fitted_mods(spark, sf_dir, "engine"), "engine")), "ware", "left")
    names = ("forward_speed", "forward_accel", "strafe_accel", "boost_speed", "boost_accel", "travel_speed", "travel_charge", "turn_rate", "turn_accel")
    return E.handling(rows, ["ship"]).select("ship", *[r(c, 5).alias(c) for c in names])


@query(f"WITH {mods_sql('shield')}, f AS (SELECT ware, max(value) FILTER (stat = 'capacity') AS ca, max(value) FILTER (stat = 'rechargerate') AS ra, max(value) FILTER (stat = 'rechargedelay') AS de FROM e GROUP BY ware), x AS (SELECT 'mod_' || p_partkey AS ware, p_size * 100.0::DOUBLE * coalesce(ca, 1) AS capacity, p_size % 5 * coalesce(ra, 1) AS rate, p_size % 3 * coalesce(de, 1) AS delay FROM part LEFT JOIN f ON f.ware = 'mod_' || p_partkey) SELECT ware, ROUND(capacity, 5) AS capacity, ROUND(rate, 5) AS rate, ROUND(delay, 5) AS delay, ROUND(delay + CASE WHEN rate <> 0 THEN capacity / rate ELSE 0 END, 4) AS refill FROM x")
def dom69_recovery(spark, sf_dir):
    size = F.col("p_size")
    shields = table(spark, sf_dir, "part").select(F.concat(F.lit("mod_"), "p_partkey").alias("ware"), (size * 100.0).alias("capacity"), (size % 5 * 1.0).alias("rate"), (size % 3 * 1.0).alias("delay"))
    out = E.recovery(shields.join(E.effects(E.realised(fitted_mods(spark, sf_dir, "shield"), "shield")), "ware", "left"), ["ware"])
    return out.select("ware", *[r(c, 5).alias(c) for c in ("capacity", "rate", "delay")], r("refill").alias("refill"))


@query(f"WITH {mods_sql('ship')} SELECT ware, ROUND(1 / coalesce(max(value) FILTER (stat = 'mass'), 1), 6) AS mass, ROUND(-coalesce(max(value) FILTER (stat = 'radarcloak'), 0), 6) AS radarcloak, ROUND(coalesce(max(value) FILTER (stat = 'missilecapacity'), 0), 6) AS missilecapacity, ROUND(coalesce(max(value) FILTER (stat = 'regiondamage'), 0), 6) AS regiondamage FROM e GROUP BY ware")
def dom70_hulls(spark, sf_dir):
    names = list(MODS["ship"])
    return E.compared(E.realised(fitted_mods(spark, sf_dir, "ship"), "ship"), names).select("ware", *[r(c, 6).alias(c) for c in names])
