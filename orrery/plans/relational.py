"""Queries of the window, join, aggregate, graph, set and scalar operators over the driver's tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.operators import aggregates as A
from orrery.operators import graph as G
from orrery.operators import joins as J
from orrery.operators import windows as W
from orrery.operators.quantiles import exact

from .roles import OFFERS_SQL, STOCK_SQL, TRADES_SQL, offers, stock, table, trades

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = 86400.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


EPOCHS_SQL = f"""{STOCK_SQL}, gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY owner ORDER BY t, ord) > 86400 THEN 1 ELSE 0 END AS gap FROM stock),
 ep AS (SELECT owner, ware, t, ord, level, sum(gap) OVER (PARTITION BY owner ORDER BY t, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM gaps),
 d AS (SELECT *, level - lag(level) OVER (PARTITION BY owner, ware, epoch ORDER BY t, ord) AS delta FROM ep)"""


def flowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.epochs(stock(spark, sf_dir).drop("raw"), ["owner"], "t", ["t", "ord"], DAY)
    return W.flows(s, ["owner", "ware", "epoch"], ["t", "ord"], "level")


@query(f"WITH {EPOCHS_SQL} SELECT owner, ware, t, ord, epoch, ROUND(level, 4) AS level, ROUND(CASE WHEN delta IS NULL THEN NULL ELSE greatest(delta, 0) END, 4) AS inflow, ROUND(CASE WHEN delta IS NULL THEN NULL ELSE greatest(-delta, 0) END, 4) AS outflow FROM d")
def win01_stock_flow(spark, sf_dir):
    return flowing(spark, sf_dir).select("owner", "ware", "t", "ord", "epoch", r("level").alias("level"), r("inflow").alias("inflow"), r("outflow").alias("outflow"))


@query(f"WITH {EPOCHS_SQL} SELECT owner, ware, count(*) AS n, ROUND(sum(greatest(delta, 0)) FILTER (delta IS NOT NULL), 2) AS inflow, ROUND(sum(greatest(-delta, 0)) FILTER (delta IS NOT NULL), 2) AS outflow, max(epoch) + 1 AS epochs FROM d GROUP BY owner, ware")
def win01_flow_totals(spark, sf_dir):
    return flowing(spark, sf_dir).groupBy("owner", "ware").agg(F.count(F.lit(1)).alias("n"), r(F.sum("inflow"), 2).alias("inflow"), r(F.sum("outflow"), 2).alias("outflow"), (F.max("epoch") + 1).alias("epochs"))


FLEET_SQL = "e AS (SELECT c_custkey // 10 AS leader, c_custkey AS follower FROM customer WHERE c_custkey // 10 > 0 AND c_custkey // 10 <> c_custkey), tree(ship, cmdr, depth) AS (SELECT follower, leader, 1 FROM e UNION ALL SELECT t.ship, e.leader, t.depth + 1 FROM tree t JOIN e ON e.follower = t.cmdr WHERE t.depth < 64)"


def checkpoints(spark: SparkSession) -> None:
    """The checkpoint folder that the cluster names; one of this machine only where none is set, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="orrery-"))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    edges = c.select(F.floor(F.col("c_custkey") / 10).cast("long").alias("leader"), F.col("c_custkey").alias("follower")).filter("leader > 0 AND leader <> follower")
    checkpoints(spark)
    return G.closure(edges).select(F.col("member").alias("ship"), F.col("root").alias("cmdr"), "depth")


@query(f"WITH RECURSIVE {FLEET_SQL} SELECT ship, cmdr, depth FROM tree")
def gr01_recursive(spark, sf_dir):
    return fleet(spark, sf_dir)


@query(f"WITH RECURSIVE {FLEET_SQL} SELECT ship, cmdr, depth, depth = max(depth) OVER (PARTITION BY ship) AS is_root_edge FROM tree")
def win02_root_edge(spark, sf_dir):
    return fleet(spark, sf_dir).withColumn("is_root_edge", F.col("depth") == F.max("depth").over(Window.partitionBy("ship")))


@query("SELECT p_partkey, p_brand, ROUND(1.0 / count(*) OVER (PARTITION BY p_brand), 9) AS weight FROM part")
def win03_weight(spark, sf_dir):
    return W.option_weight(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_brand"]).withColumn("weight", r("weight", 9))


DAILY = f"WITH {TRADES_SQL}, daily AS (SELECT seller, day, sum(total) AS value FROM trades GROUP BY seller, day)"


def daily(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("seller", "day").agg(F.sum("total").alias("value"))


@query(f"{DAILY} SELECT seller, day, ROUND(value, 2) AS value, ROUND(sum(value) OVER (PARTITION BY seller ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS running FROM daily")
def win04_cumsum(spark, sf_dir):
    return W.running(daily(spark, sf_dir), ["seller"], ["day"], "value", "running").select("seller", "day", r("value", 2).alias("value"), r("running", 2).alias("running"))


@query(f"{DAILY} SELECT seller, day, CASE WHEN count(*) OVER w = 12 THEN ROUND(avg(value) OVER w, 5) END AS mean FROM daily WINDOW w AS (PARTITION BY seller ORDER BY day ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)")
def win05_moving_avg(spark, sf_dir):
    return W.moving_average(daily(spark, sf_dir), ["seller"], ["day"], "value", 12, "mean").select("seller", "day", r("mean", 5).alias("mean"))


GRID_SQL = f"""WITH {STOCK_SQL}, e AS (SELECT owner, floor((t - 1704067200) / 86400)::BIGINT AS day, level, t, ord FROM stock),
 g AS (SELECT owner, unnest(range(0, 31)) AS day FROM (SELECT DISTINCT owner FROM e)), last AS (SELECT owner, day, arg_max(level, (t, ord)) AS level FROM e GROUP BY owner, day),
 j AS (SELECT g.owner, g.day, level FROM g LEFT JOIN last USING (owner, day))
 SELECT owner, day, level AS seen, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY owner ORDER BY day ROWS UNBOUNDED PRECEDING), first_value(level IGNORE NULLS) OVER (PARTITION BY owner ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM j"""


@query(GRID_SQL)
def win06_ffill_grid(spark, sf_dir):
    e = stock(spark, sf_dir).withColumn("day", F.floor((F.col("t") - 1704067200) / DAY).cast("long"))
    last = e.groupBy("owner", "day").agg(F.max_by("level", F.struct("t", "ord")).alias("seen"))
    grid = e.select("owner").distinct().select("owner", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30).cast("long"))).alias("day"))
    return W.fill(grid.join(last, ["owner", "day"], "left"), ["owner"], ["day"], "seen", "level").select("owner", "day", "seen", "level")


@query(f"WITH {OFFERS_SQL} SELECT place, ware, side, price, rank FROM (SELECT *, row_number() OVER (PARTITION BY place, side ORDER BY price DESC, orderkey, line, ware, owner, amount) AS rank FROM offers) WHERE rank <= 10")
def win08_topn(spark, sf_dir):
    return W.top(offers(spark, sf_dir), ["place", "side"], [F.col("price").desc(), *map(F.col, ("orderkey", "line", "ware", "owner", "amount"))], 10).select("place", "ware", "side", "price", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_custkey, c_mktsegment, ROUND((rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 + count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) / 2.0) / count(*) OVER (PARTITION BY c_mktsegment), 9) AS pct FROM customer WHERE c_acctbal <> 0")
def win09_midrank(spark, sf_dir):
    return W.midrank(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "pct").select("c_custkey", "c_mktsegment", r("pct", 9).alias("pct"))


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS slot FROM supplier")
def win10_slots(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.row_number().over(w) - 1).cast("long").alias("slot"))


@query("WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer WHERE c_acctbal > 0) SELECT c_custkey, (c_acctbal > a)::INT + (c_acctbal > b)::INT + (c_acctbal > c)::INT AS bin FROM customer, q WHERE c_acctbal > 0")
def win11_quartile_bin(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    q = exact(c, [], "c_acctbal", {f"q{k}": p for k, p in enumerate((0.25, 0.5, 0.75))})
    return c.join(F.broadcast(q), F.lit(True)).select("c_custkey", sum((F.col("c_acctbal") > F.col(f"q{k}")).cast("int") for k in range(3)).alias("bin"))  # one row


@query("SELECT p_brand, p_partkey, p_size, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT - p_size AS \"offset\" FROM part")
def win12_archive_offsets(spark, sf_dir):
    return W.offsets(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], ["p_partkey"], "p_size")


@query("SELECT coalesce(c_nationkey::VARCHAR, '') AS c_nationkey, coalesce(c_mktsegment, '') AS c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def agg01_presence(spark, sf_dir):
    return A.presence(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT c.c_custkey, count(o_orderkey) AS orders, ROUND(sum(o_totalprice), 2) AS value, count(o_orderkey) FILTER (o_orderstatus = 'O') AS open FROM customer c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c.c_custkey")
def agg02_rollups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), r(F.sum("o_totalprice"), 2).alias("value"), F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("open"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "value", F.coalesce("open", F.lit(0)).alias("open"))


@query(f"WITH {OFFERS_SQL} SELECT place, ware, side, count(*) AS offers, ROUND(sum(amount), 2) AS amount, min(price) AS price_min, ROUND(avg(price), 4) AS price_avg, max(price) AS price_max FROM offers GROUP BY place, ware, side")
def agg03_market_stat(spark, sf_dir):
    return A.market(offers(spark, sf_dir), ["place", "ware", "side"], "price", "amount").withColumns({"amount": r("amount", 2), "price_avg": r("price_avg")})


@query("""WITH rel AS (SELECT l_suppkey % 20 AS faction, l_partkey % 20 AS other, CASE l_returnflag WHEN 'R' THEN 'booster' WHEN 'A' THEN 'discount' ELSE 'base' END AS kind, (l_discount - 0.05) * 4 AS value FROM lineitem)
 SELECT faction, other, ROUND(sum(CASE WHEN kind = 'base' THEN value ELSE 0 END), 6) + 0.0 AS base, ROUND(sum(CASE WHEN kind = 'booster' THEN value ELSE 0 END), 6) + 0.0 AS booster,
 ROUND(least(1, greatest(-1, CASE WHEN bool_or(kind = 'booster') THEN sum(CASE WHEN kind = 'booster' THEN value ELSE 0 END) ELSE sum(CASE WHEN kind = 'base' THEN value ELSE 0 END) END)), 6) + 0.0 AS effective FROM rel WHERE kind IN ('base', 'booster') GROUP BY faction, other""")
def agg04_standing(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "booster").when(F.col("l_returnflag") == "A", "discount").otherwise("base")
    rel = l.select((F.col("l_suppkey") % 20).alias("faction"), (F.col("l_partkey") % 20).alias("other"), kind.alias("kind"), ((F.col("l_discount") - 0.05) * 4).alias("value"))
    return A.standing(rel, ["faction", "other"], "kind", "value").select("faction", "other", *[(r(c, 6) + 0.0).alias(c) for c in ("base", "booster", "effective")])


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def agg05_canonical(spark, sf_dir):
    return A.of_least(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice", "o_orderstatus"])


KINDS = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def agg06_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", list(KINDS)).agg(F.max("value"))


@query("SELECT event_type, min(epoch_us(ts)) AS t_min, max(epoch_us(ts)) AS t_max, count(*) AS n FROM events GROUP BY event_type")
def agg08_extent(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeats FROM lineitem")
def agg09_duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), (F.sum("c") - F.count(F.lit(1))).alias("repeats"))


@query(f"WITH {OFFERS_SQL} SELECT place, " + ", ".join(f"ROUND(coalesce(sum(amount) FILTER (flag = '{f}'), 0), 2) AS {f}" for f in "ANR") + " FROM offers GROUP BY place")
def agg12_pivot_sum(spark, sf_dir):
    return A.wide(offers(spark, sf_dir), ["place"], "flag", ["A", "N", "R"], F.col("amount")).select("place", *[r(f, 2).alias(f) for f in "ANR"])


@query(f"""WITH {STOCK_SQL}, n AS (SELECT owner, ware, count(*) AS n, min(ord) AS first FROM stock GROUP BY owner, ware)
 SELECT owner, ware AS mode, n AS mode_n FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, first) AS k FROM n) WHERE k = 1""")
def agg15_mode(spark, sf_dir):
    return A.mode(stock(spark, sf_dir), ["owner"], "ware", "ord")


@query(f"WITH {TRADES_SQL} SELECT ware, count(DISTINCT seller) AS sellers, count(DISTINCT buyer) AS buyers, ROUND(sum(amount), 2) AS amount FROM trades GROUP BY ware")
def agg16_parties(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("ware").agg(F.countDistinct("seller").alias("sellers"), F.countDistinct("buyer").alias("buyers"), r(F.sum("amount"), 2).alias("amount"))


@query(f"WITH {TRADES_SQL} SELECT seller, ROUND(sum(total), 2) AS total, count(*) AS trades, ROUND(sum(amount), 2) AS units, ROUND(sum(total) / count(*), 1) AS per_trade, ROUND(sum(total) / sum(amount), 1) AS per_unit, ROUND(sum(total) / 720, 1) AS per_hour FROM trades GROUP BY seller")
def agg18_earnings(spark, sf_dir):
    return A.earnings(trades(spark, sf_dir), ["seller"], "total", "amount", 720.0).select("seller", r("total", 2).alias("total"), "trades", r("units", 2).alias("units"), *[r(F.col("total") / d, 1).alias(n) for n, d in (("per_trade", F.col("trades")), ("per_unit", F.col("units")), ("per_hour", F.lit(720.0)))])


@query("""SELECT r_name, n_name, c_mktsegment, ROUND(sum(c_acctbal), 2) AS total, 3 - (grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)) AS depth
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 0 GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def agg20_rollup(spark, sf_dir):
    c, n, g = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"])
    return A.hierarchy(j, ["r_name", "n_name", "c_mktsegment"], "c_acctbal").withColumn("total", r("total", 2))


@query(f"WITH {OFFERS_SQL}, s AS (SELECT flag, place, sum(amount) AS amount FROM offers GROUP BY flag, place) SELECT * FROM (SELECT flag, place, round_even(10000 * amount / sum(amount) OVER (PARTITION BY flag), 0) AS bp FROM s) WHERE bp > 0")
def agg21_share_bp(spark, sf_dir):
    s = offers(spark, sf_dir).groupBy("flag", "place").agg(F.sum("amount").alias("amount"))
    return W.share(s, ["flag"], "amount", "bp").select("flag", "place", "bp")


@query("SELECT p_brand, median(p_retailprice) AS mid, quantile_cont(p_retailprice, 0.75) AS upper FROM part WHERE p_retailprice > 0 GROUP BY p_brand")
def agg22_median(spark, sf_dir):
    return A.quantiles(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", {"mid": 0.5, "upper": 0.75})


@query("""WITH b AS (SELECT least(20, greatest(1, ceil((l_discount - 0.0) / ((0.1 - 0.0) / 20))))::INT AS bin, l_tax - 0.04 AS y FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL), m AS (SELECT bin, median(y) AS m, count(*) AS n FROM b GROUP BY bin)
 SELECT ROUND(sqrt(avg(m * m)), 9) AS rms, count(*) AS bins, sum(n)::BIGINT AS n FROM m""")
def agg24_bin_rmse(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_tax") - 0.04).alias("y"))
    return A.binned_rms(l, "l_discount", "y", 0.0, 0.1, 20).withColumn("rms", r("rms", 9))


@query("SELECT l_returnflag, ROUND(avg((l_quantity > 25)::INT), 9) AS fraction FROM lineitem GROUP BY l_returnflag")
def agg25_fraction(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.avg((F.col("l_quantity") > 25).cast("double")), 9).alias("fraction"))


@query(f"WITH {OFFERS_SQL}, s AS (SELECT ware, place, sum(amount) AS amount FROM offers GROUP BY ware, place) SELECT ware, place, ROUND(amount / coalesce(nullif(max(amount) OVER (PARTITION BY ware), 0), 1), 9) AS norm FROM s")
def agg27_norm(spark, sf_dir):
    s = offers(spark, sf_dir).groupBy("ware", "place").agg(F.sum("amount").alias("amount"))
    return W.normalised(s, ["ware"], "amount", "norm").select("ware", "place", r("norm", 9).alias("norm"))


@query("SELECT l_suppkey, ROUND(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY l_suppkey")
def agg28_wavg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 9).alias("mean"))


@query("SELECT p_brand, p_size, count(*) AS n, CASE WHEN count(*) > 1 THEN count(*)::VARCHAR || 'x ' || min(p_name) ELSE min(p_name) END AS label FROM part GROUP BY p_brand, p_size")
def agg34_rollup_label(spark, sf_dir):
    return A.relabelled(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_name")


@query("""WITH j AS (SELECT s_suppkey AS follower, c_custkey AS leader, s_nationkey AS conn FROM supplier JOIN customer ON c_nationkey = s_nationkey)
 SELECT follower, min(leader) AS leader, count(DISTINCT leader) > 1 AS conflict FROM j GROUP BY follower""")
def join01_keep_first(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("follower"), F.col("s_nationkey").alias("conn"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("leader"), F.col("c_nationkey").alias("conn"))
    return J.first_leader(s, c, "conn", "follower", "leader", ["leader"]).select("follower", "leader", "conflict")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 25 ELSE o_custkey % 7 END AS k, n_name FROM orders LEFT JOIN nation ON n_nationkey = CASE WHEN o_orderstatus = 'F' THEN o_custkey % 25 ELSE o_custkey % 7 END""")
def join03_expr_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 25).otherwise(F.col("o_custkey") % 7).alias("k"))
    n = table(spark, sf_dir, "nation")
    return o.join(n, o["k"] == n["n_nationkey"], "left").select("o_orderkey", "k", "n_name")


@query("""SELECT a.event_id, a.user_id, count(b.event_id) AS followed FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id = a.event_id + 1 WHERE a.event_type = 'click' GROUP BY a.event_id, a.user_id""")
def join08_self(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = e.filter("event_type = 'click'").select("event_id", "user_id"), e.filter("event_type = 'purchase'").select((F.col("event_id") - 1).alias("event_id"), "user_id", F.lit(1).alias("hit"))
    return a.join(b, ["event_id", "user_id"], "left").groupBy("event_id", "user_id").agg(F.count("hit").alias("followed"))


@query(f"""WITH {OFFERS_SQL}, held AS (SELECT owner, ware, sum(amount) AS held FROM offers WHERE side = 'sell' GROUP BY owner, ware), ordered AS (SELECT owner, ware, sum(amount) AS ordered FROM offers WHERE side = 'buy' GROUP BY owner, ware)
 SELECT owner, ware, ROUND(coalesce(held, 0), 2) AS held, ROUND(coalesce(ordered, 0), 2) AS ordered, ROUND(coalesce(held, 0) + coalesce(ordered, 0), 2) AS allocation FROM held FULL JOIN ordered USING (owner, ware)""")
def join10_full_outer(spark, sf_dir):
    o = offers(spark, sf_dir)
    sides = {n: o.filter(F.col("side") == s).groupBy("owner", "ware").agg(F.sum("amount").alias(n)) for n, s in (("held", "sell"), ("ordered", "buy"))}
    return J.positions(sides, ["owner", "ware"]).select("owner", "ware", r("held", 2).alias("held"), r("ordered", 2).alias("ordered"), r(F.col("held") + F.col("ordered"), 2).alias("allocation"))


@query("SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned, (SELECT ROUND(sum(l_quantity), 2) FROM lineitem WHERE l_suppkey = s_suppkey) AS quantity FROM supplier")
def join11_decorrelate(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("returned"), r(F.sum("l_quantity"), 2).alias("quantity"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.join(l, s["s_suppkey"] == l["l_suppkey"], "left").select("s_suppkey", F.coalesce("returned", F.lit(0)).alias("returned"), "quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join12_semi(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("WITH c AS (SELECT nullif(c_custkey % 50, 0) AS k, c_custkey FROM customer), o AS (SELECT nullif(o_custkey % 35, 1) AS k FROM orders WHERE o_custkey % 2 = 1) SELECT c_custkey, k FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k IS NOT DISTINCT FROM c.k)")
def join14_anti_nullsafe(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif(F.col("c_custkey") % 50, F.lit(0)).alias("k"))
    o = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 1").select(F.nullif(F.col("o_custkey") % 35, F.lit(1)).alias("k"))
    return c.join(o, c["k"].eqNullSafe(o["k"]), "left_anti").select("c_custkey", "k")


@query("""WITH recipe AS (SELECT p_brand AS ware, p_size % 7 AS method, max(p_retailprice) AS price FROM part GROUP BY ALL), want AS (SELECT p_partkey, p_brand AS ware, p_size % 11 AS method FROM part)
 SELECT p_partkey, w.ware, w.method, coalesce(e.price, d.price, a.price) AS price, CASE WHEN e.price IS NOT NULL THEN 'exact' WHEN d.price IS NOT NULL THEN 'default' WHEN a.price IS NOT NULL THEN 'any' END AS matched
 FROM want w LEFT JOIN recipe e ON e.ware = w.ware AND e.method = w.method LEFT JOIN recipe d ON d.ware = w.ware AND d.method = 0 LEFT JOIN (SELECT ware, arg_min(price, method) AS price FROM recipe GROUP BY ware) a ON a.ware = w.ware""")
def join18_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    recipe = p.groupBy(F.col("p_brand").alias("ware"), (F.col("p_size") % 7).alias("method")).agg(F.max("p_retailprice").alias("price"))
    want = p.select("p_partkey", F.col("p_brand").alias("ware"), (F.col("p_size") % 11).alias("method"))
    return J.fallback(want, recipe, "ware", "method", 0, ["price"])


LANES_SQL = f"""{OFFERS_SQL}, asks AS (SELECT ware, owner AS seller, min(price / amount) AS ask FROM offers WHERE side = 'sell' GROUP BY ALL), bids AS (SELECT ware, owner AS buyer, max(price / amount) AS bid FROM offers WHERE side = 'buy' GROUP BY ALL),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ware ORDER BY ask, seller) AS k FROM asks) WHERE k <= 15), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ware ORDER BY bid DESC, buyer) AS k FROM bids) WHERE k <= 15),
 lanes AS (SELECT a.ware, seller, buyer, ask, bid, bid - ask AS spread, row_number() OVER (PARTITION BY a.ware ORDER BY bid - ask DESC, seller, buyer) AS lane FROM a JOIN b ON a.ware = b.ware WHERE bid > ask)"""


@query(f"WITH {LANES_SQL} SELECT ware, seller, buyer, ask, bid, spread, lane FROM lanes WHERE lane <= 25")
def join20_topn_theta(spark, sf_dir):
    o = offers(spark, sf_dir).withColumn("unit", F.col("price") / F.col("amount"))
    asks = o.filter("side = 'sell'").groupBy("ware", F.col("owner").alias("seller")).agg(F.min("unit").alias("ask"))
    bids = o.filter("side = 'buy'").groupBy("ware", F.col("owner").alias("buyer")).agg(F.max("unit").alias("bid"))
    return J.best_trades(asks, bids, "ware", 15, 25).select("ware", "seller", "buyer", "ask", "bid", "spread", F.col("lane").cast("long").alias("lane"))


@query(f"""WITH {STOCK_SQL}, h AS (SELECT ware, floor((t - 1704067200) / 3600)::INT AS hour, count(*) AS n, sum(level) AS level FROM stock GROUP BY ALL), g AS (SELECT ware, unnest(range(0, 744))::INT AS hour FROM (SELECT DISTINCT ware FROM h))
 SELECT ware, hour, coalesce(n, 0) AS n, ROUND(coalesce(level, 0), 4) AS level FROM g LEFT JOIN h USING (ware, hour)""")
def join21_zero_fill(spark, sf_dir):
    h = stock(spark, sf_dir).groupBy("ware", F.floor((F.col("t") - 1704067200) / 3600).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("level"))
    return J.zero_filled(h, "ware", 0, 743, "hour", ["n", "level"]).select("ware", "hour", "n", r("level").alias("level"))


@query("SELECT a.n_regionkey AS n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join22_clique(spark, sf_dir):
    return J.pairs_within(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")


@query(f"""WITH {STOCK_SQL}, q AS (SELECT owner, t, ord FROM stock WHERE ware = 'purchase'), v AS (SELECT owner, t, max(level) AS level FROM stock WHERE ware = 'view' GROUP BY ALL)
 SELECT q.owner, q.t, q.ord, v.level AS viewed FROM q ASOF LEFT JOIN v ON v.owner = q.owner AND v.t <= q.t""")
def join29_asof(spark, sf_dir):
    s = stock(spark, sf_dir)
    views = s.filter("ware = 'view'").groupBy("owner", "t").agg(F.max("level").alias("level"))
    return J.as_of(s.filter("ware = 'purchase'").select("owner", "t", "ord"), views, ["owner"], "t", "level", "viewed")


GATES_SQL = "gate AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation), adj AS (SELECT a, b FROM gate UNION SELECT b, a FROM gate UNION SELECT x.n_nationkey, y.n_nationkey FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey)"


def lanes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    gates = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b"))
    return G.adjacency(gates, n.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("cluster")))


@query(f"WITH {GATES_SQL} SELECT a, b FROM adj WHERE a <> b")
def gr03_adjacency(spark, sf_dir):
    return lanes(spark, sf_dir)


HOPS_SQL = f"WITH RECURSIVE {GATES_SQL}, walk(source, node, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT source, b, hops + 1 FROM walk JOIN adj ON a = node WHERE hops < 6)"


def hop_table(spark, sf_dir):
    checkpoints(spark)
    return G.hops(lanes(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source")), 6)


@query(f"{HOPS_SQL} SELECT source, node, min(hops) AS hops FROM walk GROUP BY source, node")
def gr04_hops(spark, sf_dir):
    return hop_table(spark, sf_dir)


@query(f"{HOPS_SQL} SELECT node, min(hops) AS hops FROM walk WHERE source IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY node")
def gr05_nearest_hostile(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("source"))
    return G.nearest(hop_table(spark, sf_dir).join(n, "source", "left_semi"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set01_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set05_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("SELECT coalesce(c_nationkey, s_nationkey) AS k, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def set06_key_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return J.positions({"c": c, "s": table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))}, ["k"])


@query("""SELECT page_id, nullif(regexp_extract(url, '^(https?)://', 1), '') AS scheme, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
 CASE WHEN contains(url, 'casino') THEN 'spam' WHEN contains(url, '.org') THEN 'org' WHEN contains(url, '.net') THEN 'net' ELSE 'other' END AS kind FROM pages""")
def fn_s_regex(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", C.empty_to_null(F.regexp_extract(u, "^(https?)://", 1)).alias("scheme"), C.empty_to_null(F.regexp_extract(u, "^https?://([^/?#]+)", 1)).alias("host"), C.slug(u).alias("slug"), C.first_fragment(u, [("casino", "spam"), (".org", "org"), (".net", "net")], "other").alias("kind"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.to_long(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def fn_explode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT c_custkey, round_even(least(30, greatest(-30, CASE WHEN abs(c_acctbal / 10000) <= 0.0032 THEN c_acctbal / 10000 / 0.00064 ELSE sign(c_acctbal) * 10 * log10(abs(c_acctbal / 10000) * 1000) END)), 1) AS db, trunc((epoch_us(TIMESTAMP '2024-01-01') / 1e6 - c_acctbal * 100 - 1704067200) / 3600)::BIGINT AS bin_cut, floor((epoch_us(TIMESTAMP '2024-01-01') / 1e6 - c_acctbal * 100 - 1704067200) / 3600)::BIGINT AS bin_floor FROM customer")
def fn_math(spark, sf_dir):
    t, anchor = F.lit(1704067200.0) - F.col("c_acctbal") * 100, F.lit(1704067200.0)
    return table(spark, sf_dir, "customer").select("c_custkey", C.signed_decibel(F.col("c_acctbal") / 10000).alias("db"), C.hour_bin(t, anchor).alias("bin_cut"), C.hour_bin(t, anchor, True).alias("bin_floor"))


@query("SELECT s_suppkey, name, value FROM (SELECT s_suppkey, s_acctbal AS balance, s_nationkey::DOUBLE AS nation FROM supplier) UNPIVOT (value FOR name IN (balance, nation))")
def unpivot(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return A.unpivoted(s, ["s_suppkey"], ["balance", "nation"], "name", "value")
