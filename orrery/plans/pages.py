"""Queries of an empire's pages over the driver's tables: raw supply, trade records, losses, paybacks, resources, standings, yards' prices and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import accounts as A
from orrery.operators import audit
from orrery.operators import books as B
from orrery.operators import charts as Q
from orrery.operators import chronicle as H
from orrery.operators import lanes as L
from orrery.operators import mining as M
from orrery.operators import trips as T

from .audits import BOOK_SQL, INFLOW_SQL, book, raw_inflow
from .building import LANES_SQL, lane_offers, ring
from .relational import checkpoints, query, r
from .roles import TRADES_SQL, seconds, table, trades
from .views import END98, LEDGER_SQL

SUPPLY_SQL = f"""{INFLOW_SQL}, raw AS (SELECT station, ware, CASE ware % 3 WHEN 0 THEN 'solid' WHEN 1 THEN 'liquid' ELSE 'gas' END AS class, CASE ware % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END AS size, 1.0::DOUBLE + ware % 5 AS volume, 5.0::DOUBLE * ((station + ware) % 4) AS used, observed, own, 40.0::DOUBLE * (station % 3) AS stock, CASE WHEN station % 3 = 2 THEN 84.0::DOUBLE END AS lim FROM inflow),
 g AS (SELECT station, class, sum(used * volume) AS class_used, sum(observed * volume) AS class_observed, count(*) AS n FROM raw GROUP BY ALL),
 p AS (SELECT station, class, size, sum(CASE WHEN size = 'XL' THEN 0 ELSE own END) / 200 AS measured, 100.0::DOUBLE + station % 9 AS hold, sum(ware % 2)::BIGINT AS miners, any_value(class_used - class_observed) AS gap FROM raw JOIN g USING (station, class) GROUP BY station, class, size),
 u AS (SELECT size, median(measured) AS usual FROM p WHERE measured > 0 GROUP BY size), q AS (SELECT p.*, CASE WHEN measured > 0 THEN measured ELSE coalesce(usual, CASE size WHEN 'S' THEN 3.0::DOUBLE WHEN 'M' THEN 2 WHEN 'L' THEN 1 ELSE 0.8::DOUBLE END) END AS rate FROM p LEFT JOIN u USING (size)),
 pools AS (SELECT *, CASE WHEN ROUND(gap, 6) <= 0 THEN 0 ELSE ceil(ROUND(gap / (hold * rate), 6))::BIGINT END AS more FROM q)"""


def supply(spark, sf_dir):
    """Wares with their rates, and pools of miners, of stations."""
    w = F.col("ware")
    x = raw_inflow(spark, sf_dir).select(
        "station", "ware", F.when(w % 3 == 0, "solid").when(w % 3 == 1, "liquid").otherwise("gas").alias("class"), F.when(w % 4 == 0, "S").when(w % 4 == 1, "M").when(w % 4 == 2, "L").otherwise("XL").alias("size"),
        (1.0 + w % 5).alias("volume"), (5.0 * ((F.col("station") + w) % 4)).alias("used"), "observed", "own", (40.0 * (F.col("station") % 3)).alias("stock"), F.when(F.col("station") % 3 == 2, 84.0).alias("limit"),
    )
    p = x.groupBy("station", "class", "size").agg((F.sum(F.when(F.col("size") == "XL", 0.0).otherwise(F.col("own"))) / 200).alias("measured"), F.sum(w % 2).alias("miners"))
    p = p.join(M.class_totals(x), ["station", "class"]).withColumns({"hold": 100.0 + F.col("station") % 9, "gap": F.col("class_used") - F.col("class_observed")})
    return x.drop("size", "own"), audit.pool_rates(p.drop("class_used", "class_observed", "n"))


def hauled(pools):
    return pools.withColumn("hold", F.col("hold") * F.col("miners"))


@query(f"""WITH {SUPPLY_SQL}, s AS (SELECT station, class, sum(hold * miners * rate) AS supply FROM pools GROUP BY ALL), y AS (SELECT raw.*, class_used, class_observed, supply, CASE WHEN class_used > 0 THEN used * volume / class_used ELSE 1.0::DOUBLE / n END AS share FROM raw JOIN g USING (station, class) JOIN s USING (station, class))
 SELECT station, ware, class, ROUND(used, 4) AS used, ROUND(observed, 4) AS observed, ROUND(observed - used, 4) AS balance, ROUND(share, 6) AS share, ROUND(class_used, 4) AS class_used, ROUND(class_observed, 4) AS class_observed, ROUND(supply * share / volume, 4) AS theoretical FROM y""")
def dom29_supply(spark, sf_dir):
    wares, pools = supply(spark, sf_dir)
    out = M.split(wares, hauled(pools))
    return out.select("station", "ware", "class", *[r(c).alias(c) for c in ("used", "observed", "balance")], r("share", 6).alias("share"), *[r(c).alias(c) for c in ("class_used", "class_observed", "theoretical")])


@query(f"""WITH {SUPPLY_SQL}, y AS (SELECT *, used > 0 AS takes, used > 0 AND lim > 0 AND stock >= 0.95 * lim AS none FROM raw),
 c AS (SELECT station, class, any_value(class_used) AS used, any_value(class_observed) AS observed, count(*) FILTER (takes) AS takes, count(*) FILTER (none) AS none, coalesce(list(ware::VARCHAR ORDER BY ware::VARCHAR) FILTER (none), []) AS blocked FROM y JOIN g USING (station, class) GROUP BY ALL),
 judged AS (SELECT *, CASE WHEN used > 0 AND ROUND(observed - used, 6) < 0 THEN CASE WHEN takes > 0 AND takes = none THEN 'full' ELSE 'short' END ELSE 'covered' END AS state FROM c),
 e AS (SELECT station, class, size, miners, more, hold * rate AS haul, state, CASE size WHEN 'S' THEN 1 WHEN 'M' THEN 2 WHEN 'L' THEN 3 ELSE 4 END AS place FROM pools JOIN judged USING (station, class)),
 o AS (SELECT station, class, string_agg('+' || more || ' ' || size, ' or ' ORDER BY place) FILTER (state = 'short' AND more > 0) AS options, min(more) FILTER (state = 'short' AND more > 0) AS least, string_agg(size || ' ' || miners || ' ' || ROUND(haul)::BIGINT, ', ' ORDER BY place) FILTER (miners > 0 OR (state = 'short' AND more > 0)) AS hauls FROM e GROUP BY ALL),
 t AS (SELECT station, coalesce(sum(least), 0)::BIGINT AS station_need FROM o GROUP BY station)
 SELECT station, class, ROUND(used, 4) AS used, ROUND(observed, 4) AS observed, ROUND(CASE WHEN used > 0 THEN observed * 100 / used END, 3) AS percent, state, coalesce(options, '') AS options, least, coalesce(hauls, '') AS hauls, array_to_string(blocked, ',') AS blocked, station_need FROM judged JOIN o USING (station, class) JOIN t USING (station)""")
def dom41_cards(spark, sf_dir):
    wares, pools = supply(spark, sf_dir)
    out = M.cards(M.split(wares, hauled(pools)), pools)
    return out.select("station", "class", r("used").alias("used"), r("observed").alias("observed"), r("percent", 3).alias("percent"), "state", F.array_join("options", " or ").alias("options"), "least", F.array_join("hauls", ", ").alias("hauls"), F.array_join("blocked", ",").alias("blocked"), "station_need")


SIDES_SQL = f"""{TRADES_SQL}, t AS (SELECT orderkey, line, t, ware, amount::BIGINT AS amount, trunc(total)::BIGINT AS money, CASE WHEN seller % 3 = 0 THEN 'PLA' WHEN seller % 3 = 1 THEN 'ARG' END AS sf, CASE WHEN buyer % 4 = 0 THEN 'PLA' ELSE 'TEL' END AS bf, CASE WHEN seller % 11 <> 0 THEN 'Dock' || seller END AS sn, 'S' || seller AS sc, CASE WHEN buyer % 13 <> 0 THEN 'Ship' || buyer ELSE '' END AS bn, CASE WHEN buyer % 5 <> 0 THEN 'B' || buyer END AS bc,
  CASE WHEN orderkey % 6 = 0 THEN 'Miner' || line END AS spn, CASE WHEN orderkey % 6 = 0 THEN 'P' || line END AS spc FROM trades)"""


@query(f"""WITH {SIDES_SQL}, led AS (SELECT 'S' || s_suppkey AS code, 'Osaka (H' || s_suppkey % 7 || ')' AS leader FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT 'P3', 'Osaka (P)'),
 a AS (SELECT *, sf IS NOT DISTINCT FROM 'PLA' AS sold, sn || ' (' || sc || ')' AS sl, CASE WHEN bn = '' THEN NULL WHEN bc IS NULL THEN bn ELSE bn || ' (' || bc || ')' END AS bl, spn || ' (' || spc || ')' AS pl FROM t WHERE (sf IS NOT DISTINCT FROM 'PLA') <> (bf = 'PLA')),
 b AS (SELECT t, ware, amount, CASE WHEN sold THEN money ELSE -money END AS money, coalesce(CASE WHEN sold THEN bf ELSE sf END, '?') || ': ' || coalesce(CASE WHEN sold THEN bl ELSE sl END, '?') AS partner, CASE WHEN sold THEN sl ELSE bl END AS own, CASE WHEN sold THEN sc ELSE bc END AS code, CASE WHEN sold THEN pl END AS proxy, CASE WHEN sold THEN spc END AS by FROM a),
 c AS (SELECT b.* REPLACE (CASE WHEN l.leader IS NULL THEN own ELSE l.leader || ' - ' || own END AS own, CASE WHEN m.leader IS NULL THEN proxy ELSE m.leader || ' - ' || proxy END AS proxy) FROM b LEFT JOIN led l ON l.code = b.code LEFT JOIN led m ON m.code = b.by)
 SELECT t, ware, amount, money, partner, coalesce(proxy, own) AS object, '' AS via FROM c WHERE coalesce(proxy, own) IS NOT NULL UNION ALL SELECT t, ware, amount, money, partner, own, proxy FROM c WHERE proxy IS NOT NULL AND own IS NOT NULL""")
def dom51_records(spark, sf_dir):
    s, b, o = F.col("seller"), F.col("buyer"), F.col("orderkey")
    text = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    none = F.lit(None).cast("string")
    t = trades(spark, sf_dir).select(
        "t", "ware", "amount", F.col("total").alias("money"), F.when(s % 3 == 0, "PLA").when(s % 3 == 1, "ARG").alias("seller_faction"), F.when(b % 4 == 0, "PLA").otherwise("TEL").alias("buyer_faction"), F.when(s % 11 != 0, text("Dock", s)).alias("seller_name"), text("S", s).alias("seller_code"),
        F.when(b % 13 != 0, text("Ship", b)).otherwise("").alias("buyer_name"), F.when(b % 5 != 0, text("B", b)).alias("buyer_code"), F.when(o % 6 == 0, text("Miner", F.col("line"))).alias("seller_proxy_name"), F.when(o % 6 == 0, text("P", F.col("line"))).alias("seller_proxy_code"), none.alias("buyer_proxy_name"), none.alias("buyer_proxy_code"),
    )
    k = F.col("s_suppkey")
    leaders = table(spark, sf_dir, "supplier").filter(k % 4 == 1).select(text("S", k).alias("code"), F.concat(F.lit("Osaka (H"), (k % 7).cast("string"), F.lit(")")).alias("leader"))
    return H.trade_records(t, leaders.unionByName(spark.createDataFrame([("P3", "Osaka (P)"), ("P3", "Zeal"), (None, "x")], "code string, leader string")))


LOST_SQL = f"""lost AS (SELECT epoch_us(o_orderdate) / 1e6 AS t, CASE WHEN o_orderkey % 9 <> 0 THEN 'Ship ' || o_custkey END AS object, CASE WHEN o_orderkey % 10 <> 0 THEN n_name END AS sector, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN upper(n_name[:3]) || ' Raider (X)' WHEN 2 THEN upper(n_name[:3]) || 'x' WHEN 3 THEN '  ' || upper(n_name[:3]) || '-7' WHEN 4 THEN upper(n_name[:3]) WHEN 5 THEN n_name ELSE 'QQQ wing' END AS killer, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 shorts AS (SELECT DISTINCT upper(n_name[:3]) AS short FROM nation WHERE n_nationkey % 3 <> 0), l AS (SELECT t, ROUND(({END98} - t) / 3600.0, 1) AS hours_ago, coalesce(object, '?') AS object, coalesce(sector, '?') AS sector, coalesce(killer, '') AS killer, coalesce(short, '?') AS faction FROM lost LEFT JOIN shorts ON regexp_matches(trim(killer), '^' || short || '($|[^A-Za-z0-9_])'))"""


def lost(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o, k, short = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.upper(F.substring("n_name", 1, 3))
    kind = k % 7
    killer = F.when(kind == 1, F.concat(short, F.lit(" Raider (X)"))).when(kind == 2, F.concat(short, F.lit("x"))).when(kind == 3, F.concat(F.lit("  "), short, F.lit("-7"))).when(kind == 4, short).when(kind == 5, F.col("n_name")).when(kind == 6, "QQQ wing")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(seconds("o_orderdate").alias("t"), F.when(k % 9 != 0, F.concat(F.lit("Ship "), "o_custkey")).alias("object"), F.when(k % 10 != 0, F.col("n_name")).alias("sector"), killer.alias("killer"))
    return H.losses(rows, n.filter("n_nationkey % 3 <> 0").select(short.alias("short")), END98)


@query(f"WITH {LOST_SQL} SELECT * FROM l")
def dom52_losses(spark, sf_dir):
    return lost(spark, sf_dir)


@query(f"WITH {LOST_SQL} SELECT faction, count(*) AS losses FROM l GROUP BY faction")
def dom52_by_faction(spark, sf_dir):
    return H.losses_by_faction(lost(spark, sf_dir))


REWARDS_SQL = "w AS (SELECT l_orderkey AS reward, 'Ship ' || l_suppkey % 60 AS ship, CASE WHEN l_suppkey % 9 <> 0 THEN 'C' || l_suppkey % 60 END AS code, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ship' ELSE 'station' END AS kind, l_partkey % 7 AS faction, CASE WHEN l_orderkey % 5 <> 0 THEN (l_orderkey % 900)::DOUBLE END AS bounty, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem)"


def rewards(spark, sf_dir):
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(k.alias("reward"), F.concat(F.lit("Ship "), s % 60).alias("ship"), F.when(s % 9 != 0, F.concat(F.lit("C"), s % 60)).alias("code"), F.when(s % 3 == 0, "").when(s % 3 == 1, "ship").otherwise("station").alias("kind"), (F.col("l_partkey") % 7).alias("faction"), F.when(k % 5 != 0, (k % 900).cast("double")).alias("bounty"), seconds("l_shipdate").alias("t"))


@query(f"WITH {REWARDS_SQL} SELECT ship || ' (' || coalesce(code, '?') || ')' AS who, coalesce(nullif(kind, ''), '?') AS kind, count(DISTINCT reward) AS rewards, ROUND(coalesce(sum(bounty), 0))::BIGINT AS bounty, count(DISTINCT faction) AS factions, ROUND(({END98} - max(t)) / 3600.0, 1) AS hours_ago FROM w GROUP BY 1, 2")
def dom52_bounties(spark, sf_dir):
    return H.bounties(rewards(spark, sf_dir), END98)


@query(f"WITH {REWARDS_SQL}, o AS (SELECT reward, max(bounty) AS bounty FROM w GROUP BY reward) SELECT count(*) AS rewards, coalesce(sum(bounty), 0) AS bounty FROM o")
def dom52_total(spark, sf_dir):
    return H.bounty_total(rewards(spark, sf_dir))


PAYBACK_SQL = f"""{LEDGER_SQL}, mods AS (SELECT l_suppkey AS station, 'm' || l_partkey % 300 AS macro FROM lineitem WHERE l_linenumber = 1), prices AS (SELECT lower('M' || p_partkey % 400) AS macro, max(p_retailprice) AS price FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1),
 v AS (SELECT station, sum(coalesce(price, 0)) AS value FROM mods LEFT JOIN prices USING (macro) GROUP BY station), pl AS (SELECT station, sum(revenue - cost) / ({END98 - 6 * 31536000} / 3600.0) AS net_h, sum(CASE WHEN t > {END98 - 3600 * 8760} THEN revenue - cost ELSE 0 END) / 8760 AS recent_h FROM ledger GROUP BY station)"""


@query(f"WITH {PAYBACK_SQL} SELECT station, ROUND(coalesce(value, 0), 2) AS value, ROUND(CASE WHEN net_h > 0 AND value > 0 THEN value / net_h END, 3) AS payback, CASE WHEN recent_h > net_h * 1.15::DOUBLE THEN 'up' WHEN recent_h < net_h * 0.85::DOUBLE THEN 'down' ELSE '' END AS trend FROM pl LEFT JOIN v USING (station)")
def dom47_payback(spark, sf_dir):
    out = A.profit_and_loss(A.entries(trades(spark, sf_dir)), END98, 6 * 31536000, 8760.0)
    modules = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("station"), F.concat(F.lit("m"), F.col("l_partkey") % 300).alias("macro"))
    wares = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("M"), F.col("p_partkey") % 400)).otherwise("").alias("component"), F.col("p_retailprice").alias("price"))
    return A.with_payback(out, A.station_values(modules, wares)).select("station", r("value", 2).alias("value"), r("payback", 3).alias("payback"), T.trend(F.col("recent_h"), F.col("net_h")).alias("trend"))


@query(f"WITH {LEDGER_SQL}, n AS (SELECT station, t, sum(revenue - cost) AS net FROM ledger GROUP BY ALL) SELECT station, t, ROUND((t - {END98}) / 3600, 4) AS hours, ROUND(sum(net) OVER (PARTITION BY station ORDER BY t), 2) AS total FROM n")
def dom47_cumulative(spark, sf_dir):
    return A.cumulative(A.entries(trades(spark, sf_dir)), END98, 90 * 86400.0).select("station", "t", r("hours").alias("hours"), r("total", 2).alias("total"))


AREAS_NOW = END98 - 4 * 31536000
AREAS_SQL = f"""area AS (SELECT l_suppkey AS sector, 'w' || l_partkey % 4 AS ware, (l_quantity - 25)::DOUBLE AS y, CASE WHEN p_partkey IS NOT NULL THEN p_size % 5 * 10 END AS capacity, p_size - 10 AS respawn, epoch_us(l_shipdate) / 1e6 AS t, CASE WHEN l_orderkey % 3 = 0 THEN 'fast' END AS speed FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON p_partkey = l_partkey),
 st AS (SELECT *, CASE WHEN y > 0 THEN 'live' WHEN coalesce(capacity, 0) = 0 THEN 'unknown' WHEN respawn < 0 THEN 'never' WHEN t <= {AREAS_NOW} THEN 'full' ELSE 'respawning' END AS status FROM area),
 m AS (SELECT *, CASE status WHEN 'live' THEN y WHEN 'full' THEN capacity ELSE 0 END AS now, CASE WHEN respawn > 0 THEN coalesce(capacity, 0)::DOUBLE / respawn * 60 ELSE 0 END AS rate, CASE WHEN status = 'respawning' THEN round_even((t - {AREAS_NOW}) / 60, 0)::BIGINT END AS eta FROM st)"""


def areas(spark, sf_dir):
    kind = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select("p_partkey", (F.col("p_size") % 5 * 10).alias("capacity"), (F.col("p_size") - 10).alias("respawn"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sector"), F.concat(F.lit("w"), F.col("l_partkey") % 4).alias("ware"), "l_partkey", (F.col("l_quantity") - 25).cast("double").alias("left"), seconds("l_shipdate").alias("start"), F.when(F.col("l_orderkey") % 3 == 0, "fast").alias("speed"))
    return A.mineable(l.join(kind, F.col("l_partkey") == F.col("p_partkey"), "left"), AREAS_NOW)


@query(f"WITH {AREAS_SQL} SELECT sector, " + ", ".join(f"ROUND(sum(CASE WHEN ware = 'w{k}' THEN now ELSE 0 END), 4)::DOUBLE AS w{k}, ROUND(sum(CASE WHEN ware = 'w{k}' THEN rate ELSE 0 END), 4) AS rep_w{k}" for k in range(4)) + " FROM m GROUP BY sector")
def dom03_resources(spark, sf_dir):
    wares = [f"w{k}" for k in range(4)]
    out = A.sector_resources(areas(spark, sf_dir), wares)
    return out.select("sector", *[r(w).alias(w) for w in wares], *[r(f"`rep.{w}`").alias(f"rep_{w}") for w in wares])


@query(f"""WITH {AREAS_SQL}, i AS (SELECT sector, ware, status, round_even(coalesce(capacity, 0)::DOUBLE, 0)::BIGINT AS capacity, round_even(now::DOUBLE, 0)::BIGINT AS now, coalesce(speed, '') AS speed, eta FROM m)
 SELECT sector, ware, string_agg(concat_ws('/', status, capacity::VARCHAR, now::VARCHAR, speed, eta::VARCHAR), ';' ORDER BY now DESC, capacity DESC, status, speed, eta NULLS FIRST) AS areas FROM i GROUP BY ALL""")
def dom03_areas(spark, sf_dir):
    lists = A.area_lists(areas(spark, sf_dir)).select("sector", F.explode("areas").alias("ware", "a"))
    text = F.transform("a", lambda x: F.concat_ws("/", x["status"], x["capacity"].cast("string"), x["now"].cast("string"), x["speed"], x["eta"].cast("string")))
    return lists.select("sector", "ware", F.array_join(text, ";").alias("areas"))


FACTIONS = [f"f{k}" for k in range(25)]
RELATIONS_SQL = "rel AS (SELECT 'f' || c_nationkey AS faction, 'f' || c_custkey % 31 AS other, max(c_acctbal / 7001) AS effective, min(c_acctbal / 10000) AS base, max(c_custkey % 5 / 10.0)::DOUBLE AS booster FROM customer WHERE c_custkey % 7 <> 0 GROUP BY ALL)"


def relations(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(k % 7 != 0).groupBy(F.concat(F.lit("f"), "c_nationkey").alias("faction"), F.concat(F.lit("f"), k % 31).alias("other")).agg(F.max(F.col("c_acctbal") / 7001).alias("effective"), F.min(F.col("c_acctbal") / 10000).alias("base"), F.max(k % 5 / 10).alias("booster"))


@query(f"WITH {RELATIONS_SQL}, f AS (SELECT 'f' || unnest(generate_series(0, 24)) AS faction) SELECT faction, " + ", ".join(f"CASE WHEN faction <> '{o}' THEN ROUND(coalesce(max(effective) FILTER (other = '{o}'), 0), 4) END AS {o}" for o in FACTIONS) + " FROM f LEFT JOIN rel USING (faction) GROUP BY faction")
def dom53_matrix(spark, sf_dir):
    return A.relation_matrix(relations(spark, sf_dir), FACTIONS)


@query(f"""WITH {RELATIONS_SQL}, f AS (SELECT 'f' || unnest(generate_series(1, 24)) AS faction), p AS (SELECT other AS faction, base, booster, least(1, greatest(-1, effective)) AS effective FROM rel WHERE faction = 'f0'),
 d AS (SELECT 'f' || s_nationkey AS faction, max(s_suppkey % 20 / 100.0)::DOUBLE AS discount FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1), li AS (SELECT faction, count(*) AS licences FROM (SELECT 'f' || unnest([p_size % 25, (p_size + 3) % 25]) AS faction FROM part WHERE p_partkey % 6 = 0) GROUP BY 1),
 x AS (SELECT faction, coalesce(base, 0) AS base, coalesce(booster, 0) AS booster, coalesce(effective, 0) AS s, coalesce(discount, 0) AS discount, coalesce(licences, 0) AS licences FROM f LEFT JOIN p USING (faction) LEFT JOIN d USING (faction) LEFT JOIN li USING (faction))
 SELECT faction, ROUND(base, 4) AS base, ROUND(booster, 4) AS booster, ROUND(s, 4) AS effective, round_even(least(30, greatest(-30, CASE WHEN abs(s) <= 0.0032 THEN s / 0.00064 ELSE sign(s) * 10 * log10(abs(s) * 1000) END)), 1) AS rank_value,
 CASE WHEN s >= 0.5 THEN 'Ally' WHEN s >= 0.1 THEN 'Friend' WHEN s >= 0.01 THEN 'Friendly' WHEN s > -0.01 THEN 'Neutral' WHEN s <= -0.999 THEN 'War' WHEN s <= -0.32 THEN 'Hostile' ELSE 'Enemy' END AS band, ROUND(discount, 3) AS discount, licences FROM x""")
def dom53_standings(spark, sf_dir):
    rel = relations(spark, sf_dir)
    me = F.lit("f0")
    off = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(F.concat(F.lit("f"), "s_nationkey").alias("faction"), me.alias("other"), (F.col("s_suppkey") % 20 / 100).alias("discount"))
    held = table(spark, sf_dir, "part").filter("p_partkey % 6 = 0").select(me.alias("faction"), F.concat(F.lit(" f"), F.col("p_size") % 25, F.lit("  f"), (F.col("p_size") + 3) % 25).alias("factions"))
    out = A.standings(FACTIONS, rel, off, held, "f0")
    return out.select("faction", r("base").alias("base"), r("booster").alias("booster"), r("effective").alias("effective"), "rank_value", "band", r("discount", 3).alias("discount"), "licences")


@query(f"""{BOOK_SQL}, y AS (SELECT c.*, shift, CASE WHEN stock + inbound + amount > 0 THEN net / (stock + inbound + amount) END AS fill, CASE WHEN price >= mean THEN high - mean ELSE mean - low END AS half FROM c LEFT JOIN off USING (station) WHERE book = 'yard' AND side = 'buy'),
 fo AS (SELECT fill, half, price, unnest(['power', 'flat', 'fitted']) AS form, low, mean, high, net / allocation AS u, population, coalesce(shift, -0.202::DOUBLE) AS own FROM y WHERE half > 0),
 po AS (SELECT *, cos(pi() * greatest(0, least(1, (u + CASE WHEN population = 'supplier' THEN 0.053::DOUBLE WHEN population = 'ration' THEN 0.006::DOUBLE WHEN form = 'flat' THEN -0.202::DOUBLE ELSE own END) / 1.095::DOUBLE))) AS pos FROM fo),
 re AS (SELECT form, fill, abs(price - CASE WHEN form = 'power' THEN low + (high - low) * greatest(0, least(1, 1 - pow(greatest(fill, 0), 2.62::DOUBLE))) ELSE mean + pos * CASE WHEN pos < 0 THEN mean - low ELSE high - mean END END) / half AS res FROM po),
 bi AS (SELECT form, least(16, greatest(1, ceil(fill / 0.075::DOUBLE)))::INT AS bin, median(res) AS m FROM re WHERE fill IS NOT NULL GROUP BY ALL), ed AS (SELECT form, quantile_cont(fill, {[k / 16 for k in range(17)]}) AS e FROM re GROUP BY form),
 eq AS (SELECT form, greatest(1, len(list_filter(list_distinct(e), lambda v: v < fill))) AS bin, median(res) AS m FROM re JOIN ed USING (form) GROUP BY ALL),
 s AS (SELECT form, count(*) AS n, median(res) AS mad, avg((res > 0.25)::INT) AS tail FROM re GROUP BY form)
 SELECT form, n, ROUND((SELECT sqrt(avg(m * m)) FROM bi WHERE bi.form = s.form), 6) AS bin_rmse, ROUND((SELECT sqrt(avg(m * m)) FROM eq WHERE eq.form = s.form), 6) AS bin_rmse_equal, ROUND(mad, 6) AS mad, ROUND(tail, 6) AS tail FROM s""")
def dom39_yard_forms(spark, sf_dir):
    checkpoints(spark)
    return B.yard_forms(book(spark, sf_dir)).select("form", "n", *[r(c, 6).alias(c) for c in ("bin_rmse", "bin_rmse_equal", "mad", "tail")])


@query(f"""{BOOK_SQL}, p AS (SELECT station, CASE WHEN fixed THEN 'fixed' ELSE 'continuum' END AS tier, count(*) AS offers FROM book WHERE book = 'shady' GROUP BY ALL), wf AS (SELECT 1 + c_custkey % 90 AS station, sum(c_nationkey % 3 // 2) AS hands FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1)
 SELECT tier, count(*) AS stations, sum(offers)::BIGINT AS offers, ROUND(avg((coalesce(hands, 0) = 0)::INT), 6) AS idle FROM p LEFT JOIN wf USING (station) GROUP BY tier""")
def dom39_shady(spark, sf_dir):
    hands = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select((1 + F.col("c_custkey") % 90).alias("station"), F.floor(F.col("c_nationkey") % 3 / 2).alias("amount"))
    return B.shady_census(B.predicted(book(spark, sf_dir)), hands).withColumn("idle", r("idle", 6))


SHIPS = [{"preset": "courier", "size": "S", "hold": 60, "speed": 3200}, {"preset": "freighter", "size": "L", "hold": 4000, "speed": 900}]
SHIPS_SQL = "(VALUES ('courier', 'S', 60.0::DOUBLE, 3200.0::DOUBLE, 120.0::DOUBLE), ('freighter', 'L', 4000.0, 900.0, 300.0)) AS sh(preset, size, hold, speed, dock)"


@query(f"""WITH {LANES_SQL}, x AS (SELECT *, floor(spread / volume / greatest(jumps, 1) * 100 + 0.5::DOUBLE + 1e-7) / 100.0::DOUBLE AS rate FROM p WHERE units > 0 OR reserve_units > 0), y AS (SELECT *, row_number() OVER (PARTITION BY ware ORDER BY rate DESC, seller, buyer) AS place FROM x),
 z AS (SELECT ware, seller, buyer, spread, volume, units, 20.0::DOUBLE + 60 * jumps AS kp, 5.0::DOUBLE * jumps AS kh, CASE WHEN jumps % 2 = 0 THEN 15.0::DOUBLE + 40 * jumps END AS qp, 30.0::DOUBLE * jumps AS qh FROM y WHERE place <= 25),
 e AS (SELECT ware, seller, buyer, preset, floor(ROUND(least(units, hold / volume), 6)) * spread AS profit, CASE WHEN size = 'S' THEN CASE WHEN qp IS NOT NULL THEN qp ELSE kp END * 1000 / (speed * 0.9::DOUBLE) + CASE WHEN qp IS NOT NULL THEN qh ELSE kh END * 1000 / 10000 ELSE (kp + kh) * 1000 / (speed * 0.9::DOUBLE) END + dock AS seconds FROM z, {SHIPS_SQL})
 SELECT ware, seller, buyer, preset, ROUND(profit, 3) AS profit, ROUND(seconds, 4) AS seconds, ROUND(profit * 3600 / seconds, 3) AS per_hour FROM e""")
def js01_trips(spark, sf_dir):
    checkpoints(spark)
    sells, buys, held = lane_offers(spark, sf_dir)
    wares = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("ware")).distinct().withColumn("volume", F.when(F.col("ware") % 9 != 0, 1.0 + F.col("ware") % 4))
    j = F.col("jumps")
    found = L.lanes(L.sellers(sells, held), L.buyers(buys), ring(spark, sf_dir), wares).join(wares, "ware").withColumns({"plain_km": 20.0 + 60 * j, "highway_km": 5.0 * j, "quick_plain_km": F.when(j % 2 == 0, 15.0 + 40 * j), "quick_highway_km": 30.0 * j})
    return T.earnings(found, SHIPS, {"S": 120, "M": 120, "L": 300, "XL": 300}).select("ware", "seller", "buyer", "preset", r("profit", 3).alias("profit"), r("seconds").alias("seconds"), r("per_hour", 3).alias("per_hour"))


@query("""WITH o AS (SELECT l_partkey % 40 AS ware, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_suppkey AS station, max(l_extendedprice / l_quantity) AS price, max(l_quantity) AS amount FROM lineitem GROUP BY ALL), m AS (SELECT ware, floor(greatest(1, max(amount)) * 0.9::DOUBLE * 0.9::DOUBLE * 0.9::DOUBLE + 0.5) AS least FROM o GROUP BY ware)
 SELECT ware, side, station, ROUND(price, 4) AS price, amount, row_number() OVER (PARTITION BY ware, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END, station) AS rank FROM o JOIN m USING (ware) WHERE amount >= least QUALIFY rank <= 10""")
def js05_book(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 40).alias("ware"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.col("l_suppkey").alias("station")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.max("l_quantity").alias("amount"))
    return T.book(o, 0.9).withColumn("price", r("price"))


@query("""WITH s AS (SELECT l_suppkey AS sector, l_partkey % 20 AS ware, sum(l_quantity) AS wants, sum(CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END) AS made, max(l_discount) * 10 AS ni, avg(l_tax) * 10 AS ns, count(*) AS k FROM lineitem GROUP BY ALL),
 t AS (SELECT *, wants / max(wants) OVER (PARTITION BY ware) AS nd, made / max(wants) OVER (PARTITION BY ware) AS nc, CASE WHEN sector % 6 <> 0 THEN 2 * (100.0::DOUBLE + k % 50 * 10) * 1000 / (0.9::DOUBLE * 700) END AS trip FROM s)
 SELECT sector, ware, ROUND(100 * (3 * nd + 2 * ni + ns - 2.5 * nc) / 8.5, 5) AS score, CASE WHEN trip > 0 AND wants > made THEN ceil(ROUND((wants - made) * 30 / (500 * 3600 / trip), 6))::BIGINT END AS traders FROM t""")
def js07_scores(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    s = l.groupBy(F.col("l_suppkey").alias("sector"), (F.col("l_partkey") % 20).alias("ware")).agg(F.sum("l_quantity").alias("wants"), F.sum(F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).otherwise(0.0)).alias("made"), (F.max("l_discount") * 10).alias("ni"), (F.avg("l_tax") * 10).alias("ns"), F.count("*").alias("k"))
    s = s.join(s.groupBy("ware").agg(F.max("wants").alias("_most")), "ware").withColumns({"nd": F.col("wants") / F.col("_most"), "nc": F.col("made") / F.col("_most")})
    way = F.when(F.col("sector") % 6 != 0, 100.0 + F.col("k") % 50 * 10)
    trip = 2 * T.seconds(way, F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(700.0), F.lit("L"), F.lit(0.0))
    return s.select("sector", "ware", r(T.score({"nd": 3, "ni": 2, "ns": 1}, {"nc": 2.5}), 5).alias("score"), T.traders((F.col("wants") - F.col("made")) * 30, F.lit(500.0), trip).alias("traders"))


MONEY_SQL = f"""{TRADES_SQL}, m AS (SELECT t, CASE ware % 9 WHEN 0 THEN 'Ship construction' WHEN 1 THEN 'Ship repair' ELSE 'w' || ware % 9 END AS ware, CASE WHEN orderkey % 8 <> 0 THEN total ELSE 0 END AS money, amount, 'N' || seller % 30 AS sn, 'C' || seller % 30 AS sc, CASE WHEN buyer % 6 <> 0 THEN 'F' || buyer % 6 END AS bf, 'B' || buyer % 20 AS bn, 'C' || buyer % 20 AS bc, flag FROM trades),
 st AS (SELECT 'C' || s_suppkey AS code FROM supplier WHERE s_suppkey % 2 = 0),
 sold AS (SELECT m.*, CASE WHEN code IS NULL THEN sn || ' (' || sc || ')' ELSE sn END AS party FROM m LEFT JOIN st ON code = sc WHERE flag <> 'R' AND money > 0),
 g AS (SELECT 'construction' AS chart, coalesce(bf, 'NIL') AS grp, t, money FROM sold WHERE ware = 'Ship construction' UNION ALL SELECT 'faction', bf, t, money FROM sold WHERE ware NOT IN ('Ship construction', 'Ship repair') AND bf IS NOT NULL UNION ALL SELECT 'seller', party, t, money FROM sold WHERE ware NOT IN ('Ship construction', 'Ship repair')
  UNION ALL SELECT 'buyer', CASE WHEN code IS NULL THEN bn || ' (' || bc || ')' ELSE bn END, t, money FROM m LEFT JOIN st ON code = bc WHERE flag = 'R' AND money > 0),
 h AS (SELECT chart, grp, trunc((t - {END98}) / 2592000)::BIGINT AS hour, sum(money) AS money FROM g GROUP BY ALL)"""


def money(spark, sf_dir):
    """Sales, buys and stations; thirty days of the table stand for an hour."""
    w, s, b = F.col("ware"), F.col("seller"), F.col("buyer")
    text = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    m = trades(spark, sf_dir).select((END98 + (F.col("t") - END98) / 720).alias("t"), F.when(w % 9 == 0, "Ship construction").when(w % 9 == 1, "Ship repair").otherwise(text("w", w % 9)).alias("ware"), F.when(F.col("orderkey") % 8 != 0, F.col("total")).otherwise(0.0).alias("money"), "amount", "flag", text("N", s % 30).alias("seller_name"), text("C", s % 30).alias("seller_code"), F.when(b % 6 != 0, text("F", b % 6)).alias("buyer_faction"), text("B", b % 20).alias("buyer_name"), text("C", b % 20).alias("buyer_code"))
    stations = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(text("C", F.col("s_suppkey")).alias("code"))
    return m.filter("flag <> 'R'"), m.filter("flag = 'R'").withColumn("money", -F.col("money")), stations


@query(f"WITH {MONEY_SQL}, z AS (SELECT chart, grp, hour, coalesce(h.money, 0) AS money FROM (SELECT DISTINCT chart, grp FROM h) JOIN (SELECT DISTINCT chart, hour FROM h) USING (chart) LEFT JOIN h USING (chart, grp, hour)) SELECT chart, grp AS \"group\", hour, ROUND(money, 2) AS money, ROUND(sum(money) OVER (PARTITION BY chart, grp ORDER BY hour ROWS UNBOUNDED PRECEDING), 2) AS running FROM z")
def dom49_charts(spark, sf_dir):
    return Q.series(Q.grouped(*money(spark, sf_dir), ["Ship repair"]), float(END98)).withColumns({"money": r("money", 2), "running": r("running", 2)})


@query(f"WITH {MONEY_SQL}, a AS (SELECT chart, hour, sum(money) AS money FROM h GROUP BY ALL) SELECT chart, hour, ROUND(mean, 4) AS mean FROM (SELECT chart, hour, CASE WHEN count(*) OVER w = 12 THEN avg(money) OVER w END AS mean FROM a WINDOW w AS (PARTITION BY chart ORDER BY hour ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)) WHERE mean IS NOT NULL")
def dom49_means(spark, sf_dir):
    return Q.means(Q.grouped(*money(spark, sf_dir), ["Ship repair"]), float(END98)).withColumn("mean", r("mean"))


@query(f"""WITH {MONEY_SQL}, v AS (SELECT unnest(CASE WHEN flag = 'R' THEN ['all'] ELSE ['external', 'all'] END) AS variant, sn, money, amount FROM m WHERE money > 0), s AS (SELECT variant, sn, sum(money) AS e, count(*) AS trades, sum(amount) AS items FROM v GROUP BY ALL)
 SELECT variant, sn AS seller_name, ROUND(e, 2) AS earnings, trades, items::DOUBLE AS items, ROUND(e / trades, 0)::DOUBLE AS per_trade, ROUND(items / trades, 0)::DOUBLE AS items_per_trade, ROUND(e / 1000, 0)::DOUBLE AS per_hour FROM s""")
def dom48_earnings(spark, sf_dir):
    sold, own, _ = money(spark, sf_dir)
    out = Q.earnings_variants(sold.filter("money > 0"), own.filter("money < 0").withColumn("money", -F.col("money")), ["seller_name"], 1000.0)
    return out.select("variant", "seller_name", r("earnings", 2).alias("earnings"), "trades", F.col("items").cast("double").alias("items"), "per_trade", "items_per_trade", "per_hour")


@query("""WITH sh AS (SELECT c_custkey AS ship, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN 'C' || c_custkey END AS code, 'm' || c_custkey % 60 AS macro FROM customer), mo AS (SELECT 'm' || p_partkey AS macro, 'Model ' || p_partkey % 50 AS model, p_size % 3 AS size, p_size * 100.0::DOUBLE AS hold, p_size % 7 * 1.0::DOUBLE AS drag FROM part WHERE p_partkey % 3 <> 0 AND p_partkey < 60),
 th AS (SELECT o_custkey AS ship, sum(CASE WHEN o_orderkey % 10 < 8 THEN (o_orderkey % 10) * 40.0::DOUBLE ELSE 0 END * (1 + o_orderkey % 3)) AS thrust FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 10 <> 9 GROUP BY 1),
 x AS (SELECT model, size, hold, CASE WHEN thrust > 0 AND drag > 0 THEN round_even(thrust / drag, 0)::BIGINT END AS speed, CASE WHEN name = '' THEN model ELSE name END || CASE WHEN code IS NULL THEN '' ELSE ' (' || code || ')' END || ' — ' || model AS label FROM sh JOIN mo USING (macro) LEFT JOIN th USING (ship))
 SELECT CASE WHEN count(*) > 1 THEN model || ' ×' || count(*) ELSE min(label) END AS label, model, size, hold, speed, count(*) AS n FROM x GROUP BY model, size, hold, speed""")
def dom27_presets(spark, sf_dir):
    k, p, size, o = F.col("c_custkey"), F.col("p_partkey"), F.col("p_size"), F.col("o_orderkey")
    ships = table(spark, sf_dir, "customer").select(k.alias("ship"), F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 5 != 0, F.concat(F.lit("C"), k)).alias("code"), F.concat(F.lit("M"), k % 60).alias("macro"))
    models = table(spark, sf_dir, "part").filter("p_partkey < 60").select(F.concat(F.lit("m"), p).alias("macro"), F.concat(F.lit("Model "), p % 50).alias("model"), (size % 3).alias("size"), (size * 100.0).alias("hold"), F.when(p % 3 != 0, "solid container").alias("tags"), (size % 7 * 1.0).alias("drag"))
    orders = table(spark, sf_dir, "orders")
    engines = orders.select(F.concat(F.lit("e"), o % 10).alias("macro"), (o % 10 * 10.0).alias("forward"), F.when(o % 10 < 8, 4.0).alias("travel_thrust")).filter("macro <> 'e9'").distinct()
    return Q.presets(ships, orders.filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("ship"), F.concat(F.lit("e"), o % 10).alias("macro"), (1 + o % 3).alias("n")), models, engines)
