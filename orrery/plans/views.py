"""Queries of the views, the incremental merge, prices and accounts over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.functions import pricing as P
from orrery.operators import accounts as A
from orrery.operators import joins as J
from orrery.streaming import merge as M

from .roles import OFFERS_SQL, STOCK_SQL, TRADES_SQL, offers, stock, table, trades

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Jan 15, 20 and 25 2024, and the end of 1998, in seconds.
JAN15, JAN20, JAN25, END98 = 1705276800, 1705708800, 1706140800, 915148800


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def r(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query("""SELECT c_custkey, round_even(least(30, greatest(-30, CASE WHEN abs(s) <= 0.0032 THEN s / 0.00064 ELSE sign(s) * 10 * log10(abs(s) * 1000) END)), 1) AS rank_value,
 CASE WHEN s >= 0.5 THEN 'Ally' WHEN s >= 0.1 THEN 'Friend' WHEN s >= 0.01 THEN 'Friendly' WHEN s > -0.01 THEN 'Neutral' WHEN s <= -0.999 THEN 'War' WHEN s <= -0.32 THEN 'Hostile' ELSE 'Enemy' END AS band
 FROM (SELECT c_custkey, c_acctbal / 10000 AS s FROM customer)""")
def fn_m08_standing(spark, sf_dir):
    s = F.col("c_acctbal") / 10000
    return table(spark, sf_dir, "customer").select("c_custkey", C.signed_decibel(s).alias("rank_value"), C.standing_band(s).alias("band"))


@query(f"""WITH area AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS y, l_partkey, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem),
 kind AS (SELECT p_partkey, p_size % 5 AS capacity, p_size - 10 AS respawn FROM part WHERE p_partkey % 3 <> 0)
 SELECT l_orderkey, l_linenumber, CASE WHEN y > 0 THEN 'live' WHEN capacity IS NULL OR capacity = 0 THEN 'unknown' WHEN respawn < 0 THEN 'never' WHEN t <= {END98 - 4 * 31536000} THEN 'full' ELSE 'respawning' END AS status FROM area LEFT JOIN kind ON p_partkey = l_partkey""")
def vw12_status(spark, sf_dir):
    area = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") - 25).alias("y"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("t"))
    kind = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select("p_partkey", (F.col("p_size") % 5).alias("capacity"), (F.col("p_size") - 10).alias("respawn"))
    status = A.area_status(F.col("y"), F.col("capacity"), F.col("respawn"), F.col("t"), F.lit(END98 - 4 * 31536000))
    return area.join(kind, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", status.alias("status"))


@query("""SELECT s_suppkey, coalesce(c_mktsegment, n_name) AS method FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_mktsegment = 'BUILDING'
 LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 2 WHERE coalesce(c_mktsegment, n_name) IS NOT NULL""")
def vw13_build_method(spark, sf_dir):
    own = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment")
    rule = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    out = s.join(own, s["s_suppkey"] == own["c_custkey"], "left").join(rule, s["s_nationkey"] == rule["n_nationkey"], "left")
    return out.select("s_suppkey", F.coalesce("c_mktsegment", "n_name").alias("method")).filter("method IS NOT NULL")


@query(f"""WITH {TRADES_SQL}, cmd AS (SELECT c_custkey AS ship, CASE WHEN c_custkey % 3 = 0 AND c_custkey >= 10 THEN c_custkey // 10 END AS cmdr FROM customer)
 SELECT orderkey, line, CASE WHEN cmdr IS NOT NULL THEN cmdr ELSE buyer END AS buyer, CASE WHEN cmdr IS NOT NULL THEN buyer END AS buyer_executor, cmdr IS NOT NULL AS buyer_proxied, c_name AS buyer_name, p_name AS ware_name, s_name AS seller_name, ROUND(price * amount, 2) AS total
 FROM trades LEFT JOIN cmd ON ship = buyer LEFT JOIN customer ON c_custkey = CASE WHEN cmdr IS NOT NULL THEN cmdr ELSE buyer END LEFT JOIN part ON p_partkey = ware LEFT JOIN supplier ON s_suppkey = seller""")
def vw06_trade(spark, sf_dir):
    c, p, s = (table(spark, sf_dir, t) for t in ("customer", "part", "supplier"))
    led = c.select(F.col("c_custkey").alias("ship"), F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") >= 10), F.floor(F.col("c_custkey") / 10).cast("long")).alias("cmdr"))
    t = A.redirected(trades(spark, sf_dir), led, "buyer")
    t = t.join(c.select("c_custkey", F.col("c_name").alias("buyer_name")), F.col("buyer") == F.col("c_custkey"), "left")
    t = t.join(p.select("p_partkey", F.col("p_name").alias("ware_name")), F.col("ware") == F.col("p_partkey"), "left").join(s.select("s_suppkey", F.col("s_name").alias("seller_name")), F.col("seller") == F.col("s_suppkey"), "left")
    return t.select("orderkey", "line", "buyer", "buyer_executor", "buyer_proxied", "buyer_name", "ware_name", "seller_name", r(F.col("price") * F.col("amount"), 2).alias("total"))


@query("""WITH e AS (SELECT o_custkey AS entity, min(epoch_us(o_orderdate)) / 1e6 AS first_seen, max(epoch_us(o_orderdate)) / 1e6 AS seen FROM orders GROUP BY o_custkey)
 SELECT entity, first_seen, CASE WHEN entity % 4 = 0 THEN seen END AS gone_time, CASE WHEN entity % 4 = 0 THEN seen ELSE 915148800 END - first_seen AS span, entity % 4 <> 0 AS alive, c_name AS name FROM e LEFT JOIN customer ON c_custkey = entity""")
def vw09_entity_life(spark, sf_dir):
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.min(t).alias("first_seen"), F.max(t).alias("seen"))
    e = e.withColumn("gone_time", F.when(F.col("entity") % 4 == 0, F.col("seen")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return e.join(c, e["entity"] == c["c_custkey"], "left").select("entity", "first_seen", "gone_time", (F.coalesce("gone_time", F.lit(float(END98))) - F.col("first_seen")).alias("span"), F.col("gone_time").isNull().alias("alive"), "name")


@query(f"WITH {TRADES_SQL} SELECT seller, buyer, min(t) AS first_t, min(orderkey) AS first_order, count(*) AS n FROM trades GROUP BY seller, buyer")
def agg07_pairs(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("seller", "buyer").agg(F.min("t").alias("first_t"), F.min("orderkey").alias("first_order"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def agg13_posts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.min_by("value", "event_id"))


@query(f"WITH {TRADES_SQL}, d AS (SELECT seller, orderkey, max(total) AS total, count(*) AS n FROM trades GROUP BY ALL) SELECT seller, count(*) AS orders, ROUND(sum(total), 2) AS total, ROUND(max(total), 2) AS best, sum(n)::BIGINT AS n FROM d GROUP BY seller")
def agg19_distinct_then_sum(spark, sf_dir):
    d = trades(spark, sf_dir).groupBy("seller", "orderkey").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n"))
    return d.groupBy("seller").agg(F.count(F.lit(1)).alias("orders"), r(F.sum("total"), 2).alias("total"), r(F.max("total"), 2).alias("best"), F.sum("n").alias("n"))


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS names, sha256(array_to_string(list(n_name ORDER BY n_name), ',')) AS digest FROM nation GROUP BY n_regionkey")
def agg33_digest(spark, sf_dir):
    names = F.array_join(F.array_sort(F.collect_list("n_name")), ",")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names")).withColumn("digest", F.sha2("names", 256))


@query(f"""WITH {OFFERS_SQL}, cargo AS (SELECT owner, ware, sum(amount) AS cargo FROM offers WHERE flag = 'N' GROUP BY ALL), inbound AS (SELECT owner, ware, sum(amount) AS inbound FROM offers WHERE flag = 'A' GROUP BY ALL), outbound AS (SELECT owner, ware, sum(amount) AS outbound FROM offers WHERE flag = 'R' GROUP BY ALL)
 SELECT owner, ware, ROUND(coalesce(cargo, 0) + coalesce(inbound, 0) - coalesce(outbound, 0), 2) AS net FROM cargo FULL JOIN inbound USING (owner, ware) FULL JOIN outbound USING (owner, ware)""")
def join15_net_positions(spark, sf_dir):
    o = offers(spark, sf_dir)
    sides = {n: o.filter(F.col("flag") == f).groupBy("owner", "ware").agg(F.sum("amount").alias(n)) for n, f in (("cargo", "N"), ("inbound", "A"), ("outbound", "R"))}
    return J.positions(sides, ["owner", "ware"]).select("owner", "ware", r(F.col("cargo") + F.col("inbound") - F.col("outbound"), 2).alias("net"))


LEDGER_SQL = f"{TRADES_SQL}, ledger AS (SELECT seller AS station, t, total AS revenue, 0.0::DOUBLE AS cost FROM trades UNION ALL SELECT buyer, t, 0.0, total FROM trades)"


@query(f"WITH {LEDGER_SQL} SELECT station, count(*) AS trades, ROUND(sum(revenue), 2) AS revenue, ROUND(sum(cost), 2) AS costs, ROUND(sum(revenue - cost), 2) AS net, ROUND(sum(revenue - cost) / ({END98 - 6 * 31536000} / 3600.0) + 0.0, 4) AS net_h, ROUND(sum(CASE WHEN t > {END98 - 3600 * 8760} THEN revenue - cost ELSE 0 END) / 8760, 4) AS recent_h FROM ledger GROUP BY station")
def dom47_pnl(spark, sf_dir):
    out = A.profit_and_loss(A.entries(trades(spark, sf_dir)), END98, 6 * 31536000, 8760.0)
    return out.select("station", "trades", *[r(c, 2).alias(c) for c in ("revenue", "costs", "net")], r("net_h").alias("net_h"), r("recent_h").alias("recent_h"))


@query(f"WITH {LEDGER_SQL}, b AS (SELECT station, floor(t / 86400)::BIGINT AS bin, sum(revenue - cost) AS net FROM ledger GROUP BY ALL) SELECT station, bin, ROUND(net, 2) AS net, ROUND(sum(net) OVER (PARTITION BY station ORDER BY bin ROWS UNBOUNDED PRECEDING), 2) AS running FROM b")
def dom49_net_series(spark, sf_dir):
    return A.net_series(A.entries(trades(spark, sf_dir))).select("station", "bin", r("net", 2).alias("net"), r("running", 2).alias("running"))


@query("""WITH band AS (SELECT p_brand, min(p_retailprice) AS lo, avg(p_retailprice) AS mid, max(p_retailprice) AS hi FROM part GROUP BY p_brand),
 s AS (SELECT p_partkey, p_retailprice, lo, mid, hi, CASE WHEN p_retailprice < mid THEN (p_retailprice - mid) / nullif(mid - lo, 0) ELSE (p_retailprice - mid) / nullif(hi - mid, 0) END AS s FROM part JOIN band USING (p_brand)),
 t AS (SELECT *, coalesce(s, 0) AS pos, acos(least(1, greatest(-1, coalesce(s, 0)))) * 1.095 / pi() AS u FROM s)
 SELECT p_partkey, ROUND(pos, 6) AS position, ROUND(u, 6) AS fill, ROUND(mid + cos(pi() * least(1, greatest(0, (u + 0.053) / 1.095))) * CASE WHEN cos(pi() * least(1, greatest(0, (u + 0.053) / 1.095))) < 0 THEN mid - lo ELSE hi - mid END, 4) AS supplier_price FROM t""")
def dom33_price_curve(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    band = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.avg("p_retailprice").alias("mid"), F.max("p_retailprice").alias("hi"))
    edges = [F.col(c) for c in ("lo", "mid", "hi")]
    s = p.join(band, "p_brand").withColumn("pos", P.position_of(F.col("p_retailprice"), *edges)).withColumn("u", P.fill(F.col("pos")))
    return s.select("p_partkey", r("pos", 6).alias("position"), r("u", 6).alias("fill"), r(P.price(P.position(F.col("u") + P.SHIFT["supplier"]), *edges)).alias("supplier_price"))


def windows(spark, sf_dir, until: int, since: int) -> tuple[DataFrame, DataFrame]:
    s = stock(spark, sf_dir).drop("raw")
    return s.filter(F.col("t") < until).withColumn("epoch", F.lit(0).cast("long")), s.filter((F.col("t") >= since) & (F.col("ord") % 7 != 0))


def merged_sql(until: int, since: int) -> str:
    return f"""WITH {STOCK_SQL}, old AS (SELECT owner, ware, t, ord, level, 0::BIGINT AS epoch FROM stock WHERE t < {until}), new AS (SELECT owner, ware, t, ord, level FROM stock WHERE t >= {since} AND ord % 7 <> 0),
 f AS (SELECT (SELECT min(t) FROM new) AS m, (SELECT count(*) FROM new WHERE t = (SELECT min(t) FROM new)) AS nn, (SELECT count(*) FROM old WHERE t = (SELECT min(t) FROM new)) AS no, (SELECT max(t) FROM old) AS last, (SELECT max(epoch) FROM old) AS e)
 SELECT old.* FROM old, f WHERE m IS NULL OR t < m OR (t = m AND nn < no) UNION ALL SELECT new.*, CASE WHEN m > last THEN e + 1 ELSE e END AS epoch FROM new, f WHERE t > m OR (t = m AND nn >= no)"""


@query(merged_sql(JAN20, JAN15))
def str02_window_merge(spark, sf_dir):
    return M.window_replace(*windows(spark, sf_dir, JAN20, JAN15))


@query(merged_sql(JAN20, JAN25))
def str03_epoch(spark, sf_dir):
    return M.window_replace(*windows(spark, sf_dir, JAN20, JAN25))


@query(f"""WITH {STOCK_SQL}, old AS (SELECT owner, ware, t, ord, level, 0::BIGINT AS epoch FROM stock WHERE t < {JAN20}), new AS (SELECT owner, ware, t, ord, level FROM stock WHERE t >= {JAN15} AND ord % 7 <> 0), first AS (SELECT ware, min(t) AS m FROM new GROUP BY ware)
 SELECT old.* FROM old LEFT JOIN first USING (ware) WHERE m IS NULL OR t < m UNION ALL SELECT *, NULL FROM new""")
def str04_keyed_merge(spark, sf_dir):
    return M.keyed_replace(*windows(spark, sf_dir, JAN20, JAN15), "ware")


@query(f"""WITH {STOCK_SQL}, old AS (SELECT owner, ware, min(ord) AS ord FROM stock WHERE t < {JAN15} GROUP BY ALL), new AS (SELECT owner, ware, min(ord) AS ord FROM stock WHERE t >= {JAN15} GROUP BY ALL)
 SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.owner IS NOT DISTINCT FROM new.owner AND old.ware IS NOT DISTINCT FROM new.ware)""")
def snk11_append_unseen(spark, sf_dir):
    s = stock(spark, sf_dir).select("owner", "ware", "ord", "t")
    old = s.filter(F.col("t") < JAN15).groupBy("owner", "ware").agg(F.min("ord").alias("ord"))
    return M.append_unseen(old, s.filter(F.col("t") >= JAN15).drop("t"), ["owner", "ware"], ["ord"])


@query(f"""WITH {STOCK_SQL}, x AS (SELECT ware AS stream, 0::BIGINT AS epoch, min(t) AS t_min, max(t) AS t_max, min(t) AS window_start, 0 AS k FROM stock WHERE t < {JAN20} GROUP BY ALL UNION ALL SELECT ware, 0, min(t), max(t), min(t), 1 FROM stock WHERE t >= {JAN15} GROUP BY ALL)
 SELECT stream, epoch, min(t_min) AS t_min, max(t_max) AS t_max, arg_max(window_start, k) AS window_start FROM x GROUP BY ALL""")
def snk12_coverage(spark, sf_dir):
    s, t = stock(spark, sf_dir), F.col("t")
    seen = [s.filter(c).groupBy(F.col("ware").alias("stream"), F.lit(0).cast("long").alias("epoch")).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min("t").alias("window_start")) for c in (t < JAN20, t >= JAN15)]
    return M.coverage(*seen)
