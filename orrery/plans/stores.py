"""Queries of versioned stores, of backfill and former logs, and of streams with sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.streaming import backfill as B
from orrery.streaming import schemas as S
from orrery.streaming import sessions as N

from .relational import query, r
from .roles import seconds, table
from .world import folder


def first_version(spark, sf_dir) -> dict:
    """Tables as a store of version 1 has them: money entries stand among the stock levels."""
    e, l, o = (table(spark, sf_dir, t) for t in ("events", "lineitem", "orders"))
    money = F.col("event_type") == "purchase"
    raw = F.when(money, F.to_json(F.struct(F.lit("sale").alias("type"), F.col("event_id").cast("string").alias("tradeentry"), F.round(F.col("value") * 100).cast("long").cast("string").alias("v"), F.when(F.col("user_id") % 2 == 0, (F.round(F.col("value") * 100) * 2).cast("long").cast("string")).alias("v2"))))
    stock = e.select(seconds("ts").alias("time"), F.col("user_id").cast("string").alias("owner_id"), F.when(money, "").otherwise(F.col("event_type")).alias("ware"), F.col("value").alias("level"), raw.alias("raw_attrs"))
    trade = l.select(seconds("l_shipdate").alias("time"), F.col("l_suppkey").cast("string").alias("seller_id"), F.col("l_quantity").alias("amount"))
    log = o.select(seconds("o_orderdate").alias("time"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("category"), F.col("o_orderpriority").alias("interact"))
    return {"stock_event": stock, "trade_tx": trade, "log_entry": log, "component": e.select("event_id"), "forgotten": e.select("event_id")}


@query("""WITH s AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), l AS (SELECT 'log:' || CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END AS stream, epoch_us(o_orderdate) / 1e6 AS t FROM orders)
 SELECT 'money_event' AS stream, min(t) AS t_min, max(t) AS t_max, count(*) AS n, ROUND(sum(round(value * 100) * CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END) / 100, 2) AS total FROM s WHERE event_type = 'purchase'
 UNION ALL SELECT 'stock_event', min(t), max(t), count(*), ROUND(sum(value), 2) FROM s WHERE event_type <> 'purchase'
 UNION ALL SELECT 'trade_tx', min(epoch_us(l_shipdate) / 1e6), max(epoch_us(l_shipdate) / 1e6), count(*), ROUND(sum(l_quantity), 2) FROM lineitem UNION ALL SELECT stream, min(t), max(t), NULL, NULL FROM l GROUP BY stream""")
def snk02_upgraded(spark, sf_dir):
    """A store of version 1 is upgraded, twice: its coverage with the rows that the tables then have."""
    store = S.Versioned(spark, folder(spark))
    store.write(first_version(spark, sf_dir), 1)
    store.upgrade(known=["component"])
    store.upgrade(known=["component"])
    t = store.tables()
    total = {"money_event": "value_cr", "stock_event": "level", "trade_tx": "amount"}
    sums = [t[n].agg(F.lit(n).alias("stream"), F.count("*").alias("n"), r(F.sum(c), 2).alias("total")) for n, c in total.items()]
    return t["coverage"].select("stream", "t_min", "t_max").join(sums[0].union(sums[1]).union(sums[2]), "stream", "left")


@query("""WITH cut AS (SELECT user_id % 7 AS g, epoch_us(ts)::BIGINT // 1000000 // 172800 AS w FROM events GROUP BY ALL), f AS (SELECT 'a/' || (w * 7 % 11) || '-' || w || '-' || g || CASE WHEN w % 13 = 12 THEN '-temp' ELSE '' END || '.xml' AS file, CASE WHEN g <> 5 THEN 'G' || g END AS guid, (w * 172800)::DOUBLE AS game_time, g, w FROM cut WHERE w % 3 <> g % 3),
 known AS (SELECT 'G' || g AS guid, (w * 172800)::DOUBLE AS game_time, w % 2 = 0 AS covered FROM cut WHERE g IN (1, 2, 3, 6) AND (g <> 2 OR w % 3 = 0) AND w % 4 <> 1), head AS (SELECT guid, max(game_time) AS head FROM known GROUP BY guid),
 a AS (SELECT f.file, f.guid, f.game_time, head, CASE WHEN contains(f.file, 'temp') THEN 'busy' WHEN f.guid IS NULL THEN 'unreadable' WHEN coalesce(covered, false) THEN 'skip' ELSE 'import' END AS action FROM f LEFT JOIN known USING (guid, game_time) LEFT JOIN head ON head.guid = f.guid),
 b AS (SELECT *, max(CASE WHEN action = 'import' THEN game_time END) OVER g AS last, max(CASE WHEN action IN ('import', 'skip') THEN game_time END) OVER g AS newest FROM a WINDOW g AS (PARTITION BY guid)),
 c AS (SELECT guid, file, game_time, CASE WHEN last < head AND newest < head AND action = 'import' THEN 'refuse' WHEN last < head AND newest >= head AND game_time = newest AND action = 'skip' THEN 'restore' ELSE action END AS action FROM b)
 SELECT guid, file, game_time, action, CASE WHEN action IN ('import', 'restore') THEN count(*) FILTER (action IN ('import', 'restore')) OVER (PARTITION BY guid ORDER BY game_time, file ROWS UNBOUNDED PRECEDING) END::INT AS turn FROM c""")
def str11_backfill_plan(spark, sf_dir):
    """Events cut into snapshots of two days for each of seven playthroughs, their files named out of order; some snapshots are known."""
    g, w = F.col("g"), F.col("w")
    cut = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("g"), F.floor(seconds("ts") / 172800).cast("long").alias("w")).distinct()
    time, none = (w * 172800).cast("double").alias("game_time"), F.lit(None).cast("string").alias("save_date")
    found = cut.filter("w % 3 <> g % 3").select(F.concat(F.lit("a/"), w * 7 % 11, F.lit("-"), w, F.lit("-"), g, F.when(w % 13 == 12, "-temp").otherwise(""), F.lit(".xml")).alias("file"), F.when(g != 5, F.concat(F.lit("G"), g)).alias("guid"), time, none)
    known = cut.filter("g IN (1, 2, 3, 6) AND (g <> 2 OR w % 3 = 0) AND w % 4 <> 1").select(F.concat(F.lit("G"), g).alias("guid"), time, none, (w % 2 == 0).alias("covered"))
    return B.plan(found, known)


@query("""WITH s AS (SELECT user_id AS owner, ts, epoch_us(ts) / 1e6 AS t, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS gap FROM events))
 SELECT owner, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY owner, k""")
def str12_sessions(spark, sf_dir):
    """Sessions of events by a stream that keeps state: two files, then one late event that closes what is open."""
    path = folder(spark)
    e = table(spark, sf_dir, "events").select("user_id", F.timestamp_micros((seconds("ts") * 1e6).cast("long")).alias("at"))
    half = e.agg(F.percentile_approx(F.col("at").cast("double"), 0.5)).first()[0]
    for k, df in enumerate((e.filter(F.col("at").cast("double") < half), e.filter(F.col("at").cast("double") >= half), e.agg(F.lit(-1).cast("long").alias("user_id"), F.max("at").alias("at")).withColumn("at", F.col("at") + F.expr("INTERVAL 30 DAYS")))):
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    N.run(spark, f"{path}/in", "user_id long, at timestamp", f"{path}/out", f"{path}/state", ["user_id"], "at", 86400, 3600).awaitTermination()
    found = spark.read.schema("user_id long, first timestamp, last timestamp, n long").parquet(f"{path}/out").filter("user_id >= 0")
    micro = lambda c: (F.unix_micros(c) / 1e6).alias(c)
    return found.select(F.col("user_id").alias("owner"), micro("first"), micro("last"), "n")


@query("""WITH o AS (SELECT epoch_us(o_orderdate) / 1e6 AS t, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS category, o_orderkey AS k FROM orders), c AS (SELECT category, min(t) AS first FROM o WHERE k % 3 = 0 AND t > 800000000 AND category IS DISTINCT FROM 'F' GROUP BY category)
 SELECT category, count(*) AS n, min(t) AS first FROM (SELECT o.category, t FROM o LEFT JOIN c ON c.category IS NOT DISTINCT FROM o.category WHERE k % 2 = 0 AND (first IS NULL OR t < first) UNION ALL SELECT category, t FROM o WHERE k % 3 = 0 AND t > 800000000 AND category IS DISTINCT FROM 'F') GROUP BY category""")
def snk14_former_log(spark, sf_dir):
    """Orders as a stored log and a former one that reaches further back; what is older is imported, twice."""
    o = table(spark, sf_dir, "orders").select(seconds("o_orderdate").alias("time"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("category"), F.col("o_orderkey").alias("k"))
    stored = o.filter((F.col("k") % 3 == 0) & (F.col("time") > 800000000) & ~F.col("category").eqNullSafe("F"))
    for _ in range(2):
        stored = stored.unionByName(B.older(stored, o.filter("k % 2 = 0"), ["category"]))
    return stored.groupBy("category").agg(F.count("*").alias("n"), F.min("time").alias("first"))
