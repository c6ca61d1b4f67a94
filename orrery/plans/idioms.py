"""Queries of single idioms: filters, dimension joins, small aggregates, orders, scalar functions and labelled views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import aggregates as A
from orrery.operators import joins as J
from orrery.sources.archive import resolved

from .relational import checkpoints, query, r
from .roles import OFFERS_SQL, TRADES_SQL, offers, table, trades


def named(spark, sf_dir, name: str, key: str, label: str, *more: str):
    """A dimension's key and label under other names."""
    return table(spark, sf_dir, name).select(key, F.col(label).alias(f"{key}_label"), *more)


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)")
def flt01_current(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    newest = l.agg(F.max("l_shipdate")).first()[0]  # a literal, so that files and partitions are pruned by it
    return l.filter(F.col("l_shipdate") == F.lit(newest)).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT p_partkey, p_name ILIKE '%RING%' AS has_ring FROM part WHERE p_name ILIKE 'RED_%' OR p_name ILIKE '%ring%' OR starts_with(p_brand, 'Brand#1')")
def flt04_like(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("RED_%") | F.col("p_name").ilike("%ring%") | F.col("p_brand").startswith("Brand#1")).select("p_partkey", F.col("p_name").ilike("%RING%").alias("has_ring"))


@query(f"WITH {TRADES_SQL} SELECT orderkey, line, floor(price * amount)::BIGINT AS money FROM trades WHERE (flag IS NULL OR flag = 'N') AND price IS NOT NULL")
def flt07_real_trades(spark, sf_dir):
    return trades(spark, sf_dir).filter((F.col("flag").isNull() | (F.col("flag") == "N")) & F.col("price").isNotNull()).select("orderkey", "line", F.floor(F.col("price") * F.col("amount")).alias("money"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type = '' OR event_type = 'view' AND value <> 50 OR event_type LIKE 'sign%'")
def flt08_filtered_distinct(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").filter((e == "") | ((e == "view") & (F.col("value") != 50)) | e.startswith("sign")).select("user_id", "event_type").dropDuplicates()


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (1, 3, 5, 7, 11) AND s_acctbal > 0 AND s_name IS NOT NULL")
def flt10_excluded_owners(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter(~F.col("s_nationkey").isin(1, 3, 5, 7, 11) & (F.col("s_acctbal") > 0) & F.col("s_name").isNotNull()).select("s_suppkey", "s_name")


@query(f"WITH {OFFERS_SQL} SELECT place, owner, ware, side, orderkey, line FROM offers WHERE amount > 0 AND price > 0 AND place IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def flt12_active_offers(spark, sf_dir):
    here = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("place"))
    return offers(spark, sf_dir).filter("amount > 0 AND price > 0").join(here, "place", "left_semi").select("place", "owner", "ware", "side", "orderkey", "line")


@query(f"WITH {OFFERS_SQL} SELECT side, owner < 20 AS own, count(*) AS n, ROUND(sum(amount), 2) AS amount FROM offers WHERE (side = 'sell' AND (owner < 20 OR price > 20000)) OR (side = 'buy' AND price > 0 AND flag <> 'R') GROUP BY ALL")
def flt13_arbitrage_sides(spark, sf_dir):
    own, sell = F.col("owner") < 20, F.col("side") == "sell"
    o = offers(spark, sf_dir).filter((sell & (own | (F.col("price") > 20000))) | (~sell & (F.col("price") > 0) & (F.col("flag") != "R")))
    return o.groupBy("side", own.alias("own")).agg(F.count("*").alias("n"), r(F.sum("amount"), 2).alias("amount"))


@query("SELECT event_type, count(*) AS n, ROUND(sum(x), 2) AS total FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 0 THEN 'inf'::DOUBLE WHEN event_id % 11 = 0 THEN '-inf'::DOUBLE WHEN event_id % 13 <> 0 THEN value END AS x FROM events) WHERE x IS NOT NULL AND isfinite(x) GROUP BY ALL")
def flt16_finite(spark, sf_dir):
    k = F.col("event_id")
    x = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf"))).when(k % 11 == 0, F.lit(float("-inf"))).when(k % 13 != 0, F.col("value"))
    return table(spark, sf_dir, "events").withColumn("x", x).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))).groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("x"), 2).alias("total"))


@query("SELECT c_custkey, c_name, n_name, r_name, upper(left(n_name, 3)) AS short FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2")
def vw04_universe(spark, sf_dir):
    n, g = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").filter("r_regionkey <> 2")
    out = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "c_name", "n_name", "r_name", F.upper(F.left("n_name", F.lit(3))).alias("short"))


@query(f"WITH {TRADES_SQL} SELECT DISTINCT seller, buyer, a.c_name AS seller_name, b.c_name AS buyer_name FROM trades JOIN customer a ON a.c_custkey = seller AND a.c_mktsegment = 'BUILDING' JOIN customer b ON b.c_custkey = buyer AND b.c_mktsegment = 'BUILDING'")
def vw11_own_pairs(spark, sf_dir):
    own = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    a, b = (own.select(F.col("c_custkey").alias(k), F.col("c_name").alias(f"{k}_name")) for k in ("seller", "buyer"))
    return trades(spark, sf_dir).select("seller", "buyer").distinct().join(a, "seller").join(b, "buyer").select("seller", "buyer", "seller_name", "buyer_name")


@query("SELECT l_orderkey, l_linenumber, p_name, coalesce(lvl, -1) AS level FROM (SELECT l_orderkey, l_linenumber, p_name, p_brand, p_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) LEFT JOIN (SELECT p_brand, p_size, max(p_partkey % 4) AS lvl FROM part WHERE p_size < 25 GROUP BY ALL) USING (p_brand, p_size)")
def join06_composite(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    levels = p.filter("p_size < 25").groupBy("p_brand", "p_size").agg(F.max(F.col("p_partkey") % 4).alias("level"))
    l = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(levels, ["p_brand", "p_size"], "left")
    return l.select("l_orderkey", "l_linenumber", "p_name", F.coalesce("level", F.lit(-1)).alias("level"))


@query(f"""WITH {TRADES_SQL} SELECT orderkey, line, b.c_name AS buyer_name, s_name AS seller_name, x.c_name AS carrier_name, p_name AS ware_name, ROUND(amount, 2) AS amount FROM trades LEFT JOIN customer b ON b.c_custkey = buyer LEFT JOIN supplier ON s_suppkey = seller LEFT JOIN customer x ON x.c_custkey = orderkey % 1000 LEFT JOIN part ON p_partkey = ware WHERE flag = 'R'""")
def vw18_pending(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b, x = (c.select(F.col("c_custkey").alias(k), F.col("c_name").alias(f"{k}_name")) for k in ("buyer", "carrier"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seller"), F.col("s_name").alias("seller_name"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ware"), F.col("p_name").alias("ware_name"))
    t = trades(spark, sf_dir).filter("flag = 'R'").withColumn("carrier", F.col("orderkey") % 1000)
    for side, k in ((b, "buyer"), (s, "seller"), (x, "carrier"), (p, "ware")):
        t = t.join(side, k, "left")
    return t.select("orderkey", "line", "buyer_name", "seller_name", "carrier_name", "ware_name", r("amount", 2).alias("amount"))


@query(f"WITH {OFFERS_SQL} SELECT owner, s_name, ware, p_name, sum(amount)::BIGINT AS amount, max(price) AS price FROM offers LEFT JOIN supplier ON s_suppkey = owner LEFT JOIN part ON p_partkey = ware WHERE side = 'buy' AND flag = 'N' GROUP BY ALL")
def vw16_supplies(spark, sf_dir):
    o = offers(spark, sf_dir).filter("side = 'buy' AND flag = 'N'").groupBy("owner", "ware").agg(F.sum("amount").cast("long").alias("amount"), F.max("price").alias("price"))
    o = o.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("owner") == F.col("s_suppkey"), "left").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("ware") == F.col("p_partkey"), "left")
    return o.select("owner", "s_name", "ware", "p_name", "amount", "price")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size % 2 = 1")
def vw19_built(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size % 2 = 1").select("p_partkey", "p_name", "p_brand")


@query(f"WITH {OFFERS_SQL} SELECT owner, s_name, ware, p_name, p_type, ROUND(sum(amount), 2) AS held, ROUND(sum(amount) / greatest(sum(sum(amount)) OVER (PARTITION BY owner), 1), 6) AS share FROM offers JOIN supplier ON s_suppkey = owner LEFT JOIN part ON p_partkey = ware GROUP BY owner, s_name, ware, p_name, p_type")
def vw21_allocation(spark, sf_dir):
    o = offers(spark, sf_dir).groupBy("owner", "ware").agg(F.sum("amount").alias("held"))
    o = o.withColumn("share", F.col("held") / F.greatest(F.sum("held").over(Window.partitionBy("owner")), F.lit(1)))
    o = o.join(table(spark, sf_dir, "supplier"), F.col("owner") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("ware") == F.col("p_partkey"), "left")
    return o.select("owner", "s_name", "ware", "p_name", "p_type", r("held", 2).alias("held"), r("share", 6).alias("share"))


@query("SELECT l_suppkey, l_partkey, p_name, count(*) AS n, p_type = 'ECONOMY' AS is_unit FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def vw22_census(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return n.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "l_partkey", "p_name", "n", (F.col("p_type") == "ECONOMY").alias("is_unit"))


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY' GROUP BY ALL")
def vw23_units(spark, sf_dir):
    return vw22_census(spark, sf_dir).filter("is_unit").select("l_suppkey", "l_partkey", "n")


@query("WITH c AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS cost FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), p AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS profit FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) SELECT k, m::DATE AS month, ROUND(coalesce(cost, 0), 2) AS cost, ROUND(coalesce(profit, 0), 2) AS profit FROM c FULL JOIN p USING (k, m)")
def join16_costs_profits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.trunc("o_orderdate", "month").alias("month"), "o_orderstatus", "o_totalprice")
    sides = {n: o.filter(F.col("o_orderstatus") == s).groupBy("k", "month").agg(F.sum("o_totalprice").alias(n)) for n, s in (("cost", "F"), ("profit", "O"))}
    return J.positions(sides, ["k", "month"]).select("k", "month", r("cost", 2).alias("cost"), r("profit", 2).alias("profit"))


@query("SELECT l_suppkey, l_linenumber, l_orderkey, q.p_partkey AS option, ROUND(weight, 6) AS weight FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN (SELECT p_brand, p_size, p_partkey, 1.0 / count(*) OVER (PARTITION BY p_brand, p_size) AS weight FROM part WHERE p_type = 'PROMO') q ON q.p_brand = p.p_brand AND q.p_size = p.p_size")
def join17_options(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    choices = p.filter("p_type = 'PROMO'").select("p_brand", "p_size", F.col("p_partkey").alias("option"))
    choices = choices.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("p_brand", "p_size")))
    return table(spark, sf_dir, "lineitem").join(p.select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(choices, ["p_brand", "p_size"]).select("l_suppkey", "l_linenumber", "l_orderkey", "option", r("weight", 6).alias("weight"))


@query("""WITH e AS (SELECT c_nationkey AS entity, min(c_custkey) AS id FROM customer GROUP BY ALL) SELECT o_orderkey, coalesce(id, o_custkey) AS now_id, CASE WHEN c_name IS NOT NULL THEN c_name WHEN s_name IS NOT NULL THEN s_name || ' (gone)' ELSE 'unknown' END AS label
 FROM orders LEFT JOIN e ON entity = o_custkey LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 LEFT JOIN supplier ON s_suppkey = o_custkey""")
def join23_rekeyed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    first = c.groupBy(F.col("c_nationkey").cast("long").alias("o_custkey")).agg(F.min("c_custkey").alias("id"))
    here = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    gone = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"), "s_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    for side in (first, here, gone):
        o = o.join(side, "o_custkey", "left")
    label = F.coalesce("c_name", F.concat("s_name", F.lit(" (gone)")), F.lit("unknown"))
    return o.select("o_orderkey", F.coalesce("id", "o_custkey").alias("now_id"), label.alias("label"))


@query("SELECT p_partkey, p_name, k FROM part LEFT JOIN (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_size < 30 GROUP BY ALL) USING (p_name)")
def join25_by_name(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = p.filter("p_size < 30").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return p.select("p_partkey", "p_name").join(first, "p_name", "left")


@query("WITH e AS (SELECT c_custkey AS id, c_custkey * 7 % 500 AS own, (c_custkey * 11 + 3) % 500 AS target FROM customer) SELECT a.id, arg_max(b.id, b.id) AS partner FROM e a JOIN e b ON a.target = b.own AND a.id <> b.id GROUP BY a.id")
def join26_partners(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 500).alias("own"), ((F.col("c_custkey") * 11 + 3) % 500).alias("target"))
    last = e.groupBy(F.col("own").alias("target")).agg(F.max_by("id", "id").alias("last"), F.sort_array(F.collect_set("id"), False).alias("ids"))
    out = e.join(last, "target").select("id", F.try_element_at(F.filter("ids", lambda x: x != F.col("id")), F.lit(1)).alias("partner"))
    return out.filter("partner IS NOT NULL")


@query("SELECT p_partkey, s_suppkey IS NOT NULL AS supplied, c_custkey IS NOT NULL AS owned, CASE WHEN c_custkey IS NOT NULL THEN 'player' WHEN s_suppkey IS NOT NULL THEN 'supplies' WHEN p_size > 40 THEN 'shady' WHEN p_type = 'PROMO' THEN 'yard' ELSE 'main' END AS kind FROM part LEFT JOIN (SELECT DISTINCT l_partkey, min(l_suppkey) AS s_suppkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON l_partkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey AND c_mktsegment = 'BUILDING'")
def join31_price_book(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    supplied = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("supplied", F.lit(True))
    owned = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("p_partkey"), F.lit(True).alias("owned"))
    out = p.join(supplied, "p_partkey", "left").join(owned, "p_partkey", "left").fillna(False, ["supplied", "owned"])
    kind = F.when(F.col("owned"), "player").when(F.col("supplied"), "supplies").when(F.col("p_size") > 40, "shady").when(F.col("p_type") == "PROMO", "yard").otherwise("main")
    return out.select("p_partkey", "supplied", "owned", kind.alias("kind"))


@query("SELECT n_name, p_type, ROUND(n_nationkey * base, 4) AS rate FROM nation, (SELECT p_type, avg(p_retailprice) AS base FROM part GROUP BY ALL)")
def join32_grid(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").groupBy("p_type").agg(F.avg("p_retailprice").alias("base"))
    return table(spark, sf_dir, "nation").crossJoin(kinds).select("n_name", "p_type", r(F.col("n_nationkey") * F.col("base")).alias("rate"))  # two short dimensions


@query(f"WITH {OFFERS_SQL} SELECT owner, ware, max(amount) AS most, min(side) AS side, count(*) AS n, count(DISTINCT place) AS places, arg_min(price, orderkey * 8 + line) AS first_price, ROUND(sum(amount), 2) AS amount, ROUND(sum(price), 2) AS price FROM offers GROUP BY ALL")
def agg10_max_min(spark, sf_dir):
    order = F.col("orderkey") * 8 + F.col("line")
    return offers(spark, sf_dir).groupBy("owner", "ware").agg(F.max("amount").alias("most"), F.min("side").alias("side"), F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.min_by("price", order).alias("first_price"), r(F.sum("amount"), 2).alias("amount"), r(F.sum("price"), 2).alias("price"))


@query("SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS members, count(*) AS n, max(n_nationkey) AS top FROM nation GROUP BY ALL")
def agg29_lists(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_nationkey")).cast("array<string>"), ",").alias("members"), F.count("*").alias("n"), F.max("n_nationkey").alias("top"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def agg31_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").count().withColumnRenamed("count", "n")


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, event_id")
def agg32_first_by_key(spark, sf_dir):
    return A.distinct_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH e AS (SELECT quantile_cont(c_acctbal, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) AS q FROM customer), b AS (SELECT c_acctbal, c_custkey % 97 / 97.0 AS y, greatest(1, len(list_filter(q, lambda x: x < c_acctbal))) AS bin FROM customer, e), m AS (SELECT bin, median(y) AS m, count(*) AS n FROM b GROUP BY bin)
 SELECT ROUND(sqrt(avg(m * m)), 6) AS rms, count(*) AS bins, sum(n)::BIGINT AS n FROM m""")
def agg24_equal_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_acctbal", (F.col("c_custkey") % 97 / 97).alias("y"))
    return A.equal_count_rms(c, "c_acctbal", "y", 8).withColumn("rms", r("rms", 6))


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_mktsegment), c_custkey) AS by_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END NULLS LAST, c_custkey) AS by_value, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 2, c_custkey) AS load_order FROM customer""")
def srt02_orders(spark, sf_dir):
    w = lambda *o: F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*o))
    value = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", w(F.lower("c_mktsegment"), "c_custkey").alias("by_name"), w(value.asc_nulls_last(), "c_custkey").alias("by_value"), w(F.col("c_custkey") % 2, "c_custkey").alias("load_order"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def srt05_newest(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)  # a page: the limit is the feature


@query("SELECT p_partkey, unnest(regexp_extract_all(line, '(\\w+)=(\\d+)', 1)) AS name, unnest(regexp_extract_all(line, '(\\w+)=(\\d+)', 2))::BIGINT AS number FROM (SELECT p_partkey, 'size=' || p_size || ', brand=' || replace(p_brand, 'Brand#', '') || CASE WHEN p_size % 2 = 0 THEN ' even=1' ELSE '' END AS line FROM part)")
def fn_s04_pairs(spark, sf_dir):
    text = F.concat(F.lit("size="), "p_size", F.lit(", brand="), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.when(F.col("p_size") % 2 == 0, " even=1").otherwise(""))
    pairs = lambda g: F.regexp_extract_all("line", F.lit(r"(\w+)=(\d+)"), F.lit(g))
    p = table(spark, sf_dir, "part").withColumn("line", text).select("p_partkey", F.explode(F.arrays_zip(pairs(1).alias("name"), pairs(2).alias("number"))).alias("e"))
    return p.select("p_partkey", "e.name", F.col("e.number").cast("long").alias("number"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS first, nullif(split_part(p_name, ' ', 2), '') AS second, nullif(split_part(p_name, ' ', 3), '') AS third, '[' || upper(left(p_type, 3)) || '] ' || p_name AS label, coalesce(nullif(regexp_extract(p_brand, '^[A-Za-z]+#(\\d+)$', 1), ''), 'none') AS short,
 substr(p_brand, 7) AS rest, CASE WHEN regexp_matches(p_name, '^(red|small) ') THEN split_part(p_name, ' ', 2) END AS kind FROM part""")
def fn_s06_split(spark, sf_dir):
    parts = F.split("p_name", " ")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    label = F.concat(F.lit("["), F.upper(F.left("p_type", F.lit(3))), F.lit("] "), "p_name")
    short = F.coalesce(F.nullif(F.regexp_extract("p_brand", r"^[A-Za-z]+#(\d+)$", 1), F.lit("")), F.lit("none"))
    return table(spark, sf_dir, "part").select("p_partkey", at(1).alias("first"), at(2).alias("second"), at(3).alias("third"), label.alias("label"), short.alias("short"), F.substring("p_brand", 7, 99).alias("rest"), F.when(F.regexp_like("p_name", F.lit("^(red|small) ")), at(2)).alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_quantity / 7)::BIGINT AS cycles, CASE WHEN l_tax > 0 THEN ceil((l_extendedprice / 1000 - l_quantity) / l_tax)::BIGINT END AS units, ROUND(sqrt(l_quantity * l_quantity + l_discount * l_discount) / 1000, 8) AS km, ROUND(l_quantity / (l_discount + 1), 4) AS speed, ROUND(1 / (1 + l_linenumber::DOUBLE), 6) AS near,
 CASE WHEN l_discount > 0.05 THEN ROUND((100 - l_quantity) / l_discount, 2) END AS hours_to_full FROM lineitem""")
def fn_m03_arithmetic(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    units = F.when(t > 0, F.ceil((F.col("l_extendedprice") / 1000 - q) / t))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(q / 7).alias("cycles"), units.alias("units"), r(F.hypot(q, d) / 1000, 8).alias("km"), r(q / (d + 1)).alias("speed"), r(1 / (1 + F.col("l_linenumber")), 6).alias("near"), F.when(d > 0.05, r((100 - q) / d, 2)).alias("hours_to_full"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN (props->>'$.k2')::BIGINT END, (props->>'$.k')::BIGINT) AS v, '{\"a\":' || (event_id % 7) || ',\"t\":\"' || event_type || '\"}' AS attrs FROM events")
def fn_j02_attributes(spark, sf_dir):
    pick = lambda p: F.get_json_object("props", p).cast("long")
    attrs = F.to_json(F.struct((F.col("event_id") % 7).alias("a"), F.col("event_type").alias("t")))  # in the order of names
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 3 == 0, pick("$.k2")), pick("$.k")).alias("v"), attrs.alias("attrs"))


@query("WITH s AS (SELECT c_nationkey, c_mktsegment, array_to_string(list(c_custkey ORDER BY c_acctbal DESC, c_custkey), ',') AS ids FROM customer GROUP BY ALL) SELECT c_nationkey, unnest(list(c_mktsegment ORDER BY c_mktsegment)) AS key, unnest(list(ids ORDER BY c_mktsegment)) AS value FROM s GROUP BY c_nationkey")
def fn_a03_nested_map(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sort_array(F.collect_list(F.struct((-F.col("c_acctbal")).alias("a"), "c_custkey"))).alias("x"))
    ids = F.array_join(F.transform("x", lambda e: e["c_custkey"].cast("string")), ",")
    m = c.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", ids))).alias("m"))
    return m.select("c_nationkey", F.explode("m"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '{7,1} ' || c_mktsegment ELSE n_name || ' of ' || r_name || '  (' || c_mktsegment || ')' END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def prj05_references(spark, sf_dir):
    checkpoints(spark)
    n, g = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = n.select(F.lit(1).alias("page"), F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(" of {2, "), "n_regionkey", F.lit("}")).alias("text")).unionByName(g.select(F.lit(2).alias("page"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("text")))
    name = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("{7,1} "), "c_mktsegment")).otherwise(F.concat(F.lit("{1,"), "c_nationkey", F.lit("} (a note (in it)) \\("), "c_mktsegment", F.lit("\\)")))
    return resolved(table(spark, sf_dir, "customer").select("c_custkey", name.alias("label")), "c_custkey", "label", known)
