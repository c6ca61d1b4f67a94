"""Queries of the entity registry and of the store that snapshots are merged into."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.streaming import merge as M
from orrery.streaming import registry as R

from .relational import checkpoints, query
from .roles import STOCK_SQL, stock, table
from .views import JAN15, JAN20, JAN25

NOW = 100.0


def evidence(spark, sf_dir):
    """(components, entities) of customers, two to a code: some codes have two components and one entity, the others one and two."""
    c = table(spark, sf_dir, "customer").withColumn("g", F.floor(F.col("c_custkey") / 2).cast("long")).withColumn("odd", F.col("c_custkey") % 2 == 1)
    shared = [F.concat(F.lit("C"), "g").alias("code"), F.when(F.col("g") % 2 == 0, "ship_m").otherwise("station").alias("class"), F.concat(F.lit("m"), F.col("c_nationkey") % 3).alias("macro"), F.col("c_mktsegment").alias("owner")]
    spawn = (F.col("g") % 100).cast("double")
    gone = F.col("c_custkey") % 5 == 0
    entities = c.filter("g % 3 <> 0 OR NOT odd").select(
        F.col("c_custkey").alias("entity_id"), *shared, F.col("c_name").alias("name"), spawn.alias("spawntime"), F.lit(0.0).alias("first_seen"),
        (F.col("c_custkey") % 7).cast("double").alias("last_seen"), F.when(gone, 50.0).alias("gone_time"), F.when(gone, "disappeared").alias("gone_reason"),
    )
    name = F.when(F.col("c_custkey") % 17 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    components = c.filter("g % 11 <> 0 AND (g % 3 = 0 OR odd)").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("["), "c_custkey", F.lit("]")).alias("id"), *shared, name.alias("name"), F.when(F.col("g") % 13 == 0, spawn + 0.5).otherwise(spawn).alias("spawntime"))
    return components, entities


EVIDENCE_SQL = f"""c AS (SELECT *, c_custkey // 2 AS g, c_custkey % 2 = 1 AS odd, 'C' || (c_custkey // 2) AS code, CASE WHEN (c_custkey // 2) % 2 = 0 THEN 'ship_m' ELSE 'station' END AS class, 'm' || (c_nationkey % 3) AS macro, c_mktsegment AS owner, ((c_custkey // 2) % 100)::DOUBLE AS spawn FROM customer),
 ent AS (SELECT c_custkey AS entity_id, code, class, macro, owner, c_name AS name, spawn AS spawntime, 0.0::DOUBLE AS first_seen, (c_custkey % 7)::DOUBLE AS last_seen, CASE WHEN c_custkey % 5 = 0 THEN 50.0::DOUBLE END AS gone_time, CASE WHEN c_custkey % 5 = 0 THEN 'disappeared' END AS gone_reason FROM c WHERE g % 3 <> 0 OR NOT odd),
 comp AS (SELECT c_custkey AS ord, '[' || c_custkey || ']' AS id, code, class, macro, owner, CASE WHEN c_custkey % 17 = 0 THEN c_name || 'x' ELSE c_name END AS name, CASE WHEN g % 13 = 0 THEN spawn + 0.5 ELSE spawn END AS spawntime FROM c WHERE g % 11 <> 0 AND (g % 3 = 0 OR odd)),
 ranked AS (SELECT ord, entity_id, row_number() OVER (PARTITION BY code ORDER BY ord, gone_time IS NULL DESC, gone_time IS NULL AND comp.macro = ent.macro DESC, gone_time IS NULL AND comp.owner = ent.owner DESC, CASE WHEN gone_time IS NULL THEN last_seen ELSE -last_seen END, CASE WHEN gone_time IS NULL THEN entity_id ELSE -entity_id END) AS k FROM comp JOIN ent USING (code, class, spawntime)),
 fresh AS (SELECT ord, (SELECT max(entity_id) FROM ent) + row_number() OVER (ORDER BY ord) AS entity_id FROM comp WHERE ord NOT IN (SELECT ord FROM ranked WHERE k = 1)),
 told AS (SELECT ord, entity_id FROM ranked WHERE k = 1)"""


@query(f"""WITH {EVIDENCE_SQL}
 SELECT entity_id, ent.code, ent.class, ent.macro, comp.owner, comp.name, ent.spawntime, first_seen, {NOW}::DOUBLE AS last_seen, NULL::DOUBLE AS gone_time, NULL::VARCHAR AS gone_reason FROM told JOIN ent USING (entity_id) JOIN comp USING (ord)
 UNION ALL SELECT entity_id, code, class, macro, owner, name, spawntime, {NOW}, {NOW}, NULL, NULL FROM fresh JOIN comp USING (ord)
 UNION ALL SELECT entity_id, code, class, macro, owner, name, spawntime, first_seen, last_seen, coalesce(gone_time, {NOW}), CASE WHEN gone_time IS NOT NULL THEN gone_reason WHEN (code, class) IN (SELECT (code, class) FROM fresh JOIN comp USING (ord)) THEN 'recycled' ELSE 'disappeared' END FROM ent WHERE entity_id NOT IN (SELECT entity_id FROM told)""")
def ent01_registry(spark, sf_dir):
    checkpoints(spark)
    return R.reconcile(*evidence(spark, sf_dir), NOW)[0]


@query(f"WITH {EVIDENCE_SQL} SELECT ord, id, entity_id FROM comp JOIN (SELECT * FROM told UNION ALL SELECT * FROM fresh) USING (ord)")
def ent03_mapping(spark, sf_dir):
    checkpoints(spark)
    return R.reconcile(*evidence(spark, sf_dir), NOW)[1]


@query(f"""WITH {EVIDENCE_SQL}, pair AS (SELECT entity_id, ent.owner AS o1, comp.owner AS o2, ent.name AS n1, comp.name AS n2 FROM told JOIN ent USING (entity_id) JOIN comp USING (ord))
 SELECT entity_id, 'captured' AS kind, {NOW}::DOUBLE AS t, o1 AS was, o2 AS now FROM pair WHERE o1 IS DISTINCT FROM o2 UNION ALL SELECT entity_id, 'renamed', {NOW}, n1, n2 FROM pair WHERE n1 IS DISTINCT FROM n2""")
def ent04_changes(spark, sf_dir):
    checkpoints(spark)
    return R.reconcile(*evidence(spark, sf_dir), NOW)[2]


@query(f"WITH {EVIDENCE_SQL} SELECT ord, id, entity_id FROM comp LEFT JOIN told USING (ord)")
def ent06_read_only(spark, sf_dir):
    return R.reconcile(*evidence(spark, sf_dir), 5.0)[1]


def merged(spark, sf_dir) -> M.Store:
    """A store of snapshots that end at three times, the second of which comes again, and one too late; user_id is the series."""
    checkpoints(spark)
    store = M.Store(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    s = stock(spark, sf_dir).select("t", "ord", F.col("owner").cast("string").alias("series"), F.col("ware").alias("item"), "level")
    second = s.filter((F.col("t") >= JAN15) & (F.col("t") < JAN25) & (F.col("ord") % 7 != 0))
    assert M.process(store, s.filter(F.col("t") < JAN20), JAN20)
    assert M.process(store, second, JAN25)
    assert M.process(store, second, JAN25)
    assert not M.process(store, s.filter(F.col("t") < JAN15), JAN15)
    assert M.process(store, s.filter(F.col("t") >= JAN25 + 86400).withColumn("t", F.when(F.col("ord") % 50 != 0, F.col("t"))), JAN25 + 30 * 86400)
    return store


MERGED_SQL = f"""{STOCK_SQL}, s AS (SELECT t, ord, owner::VARCHAR AS series, ware AS item, level FROM stock), a AS (SELECT * FROM s WHERE t < {JAN20}), b AS (SELECT * FROM s WHERE t >= {JAN15} AND t < {JAN25} AND ord % 7 <> 0), c AS (SELECT * FROM s WHERE t >= {JAN25} + 86400 AND ord % 50 <> 0),
 kept AS (SELECT * FROM a WHERE t < (SELECT min(t) FROM b)), done AS (SELECT *, 0::BIGINT AS epoch FROM kept UNION ALL SELECT *, 0 FROM b UNION ALL SELECT *, CASE WHEN (SELECT min(t) FROM c) > (SELECT max(t) FROM b) THEN 1 ELSE 0 END FROM c)"""


@query(f"WITH {MERGED_SQL} SELECT t, ord, series, item, level, epoch FROM done")
def str06_replayed(spark, sf_dir):
    return merged(spark, sf_dir).read("events", f"{M.EVENTS}, epoch long")


@query(f"""WITH {MERGED_SQL}, w AS (SELECT 0::BIGINT AS epoch, t, 0 AS k FROM a UNION ALL SELECT 0, t, 1 FROM b UNION ALL SELECT 1, t, 2 FROM c)
 SELECT 'events' AS stream, epoch, min(t) AS t_min, max(t) AS t_max, min(t) FILTER (k = (CASE WHEN epoch = 0 THEN 1 ELSE 2 END)) AS window_start FROM w GROUP BY epoch""")
def snk08_ledger(spark, sf_dir):
    return merged(spark, sf_dir).read("coverage", M.COVERAGE)
