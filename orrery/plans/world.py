"""Queries of the snapshot's tables and of the views on them: documents and frames are made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import views as V
from orrery.sources import snapshot_tables as T
from orrery.sources import snapshot_xml as X
from orrery.streaming import snapshots as S

from .relational import checkpoints, query, r
from .roles import table

#: Stations of a document, so that a document is bounded and their number grows with the table.
BLOCK = 20


def folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares its files."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/world-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(doc, value): an XML document for each block of suppliers, who are stations with goods, offers, workers and limits from their lineitems."""
    tag = lambda name, **a: F.concat(F.lit(f"<{name}"), *[F.concat(F.lit(f' {k}="'), F.coalesce(F.col(v).cast("string") if isinstance(v, str) else v.cast("string"), F.lit("")), F.lit('"')) for k, v in a.items()], F.lit("/>"))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c) if isinstance(c, str) else c)
    l = table(spark, sf_dir, "lineitem").filter(where).filter("l_linenumber <= 6")
    ware, amount, k = text("Ware_", F.col("l_partkey") % 7), F.col("l_quantity").cast("int"), F.col("l_linenumber")
    own = F.when(k <= 2, tag("ware", ware=ware, amount=amount)).when(k == 3, tag("trade", id="l_orderkey", buyer="l_suppkey", ware=ware, price=F.round(F.col("l_extendedprice") * 100).cast("long"), amount=amount, flags=F.when(F.col("l_returnflag") == "R", "supplies")))
    own = own.when(k == 4, tag("workforce", race="l_returnflag", amount=amount)).otherwise(tag("ware", ware=ware, amount=amount))
    kind = F.when(k <= 2, 0).when(k == 5, 3).when(k == 6, 4).otherwise(k - 2)
    line = F.struct(kind.alias("kind"), "l_orderkey", "l_partkey", "l_quantity", own.alias("xml"))
    lines = l.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # those of one supplier
    part = lambda n: F.array_join(F.transform(F.filter("lines", lambda x: x["kind"] == n), lambda x: x["xml"]), "")
    inner = [("<component class=\"storage\"><cargo>", part(0), "</cargo></component>"), ("<trade><offers><production>", part(1), "</production></offers></trade>"), ("<workforces>", part(2), "</workforces>"), ("<overrides><max>", part(3), "</max><sell>"), ("", part(4), "</sell></overrides>")]
    s = table(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    head = F.format_string('<component class="sector" macro="SEC_%d_Macro" id="c%d" connection="x"><component class="station" macro="Station_%d" id="s%d" code="STA-%d" owner="%s"%s><offset><position x="%d" z="-%d"/></offset>', "s_nationkey", "s_nationkey", F.col("s_nationkey"), "s_suppkey", "s_suppkey", F.when(F.col("s_nationkey") % 3 == 0, "player").otherwise("npc"), F.when(F.col("s_suppkey") % 13 == 0, "").otherwise(' connection="y"'), "s_suppkey", "s_suppkey")
    station = F.concat(head, *[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for p in inner for x in p], F.lit("</component></component>"))
    doc = F.floor(F.col("s_suppkey") / BLOCK).cast("long")
    docs = s.select(doc.alias("doc"), F.struct("s_suppkey", station.alias("xml")).alias("s")).groupBy("doc").agg(F.array_sort(F.collect_list("s")).alias("all"))
    head = F.format_string('<savegame><info><save date="%d"/><game guid="G%d" version="9" time="%d.5"/><player name="P%d" money="%d"/></info><universe>', "doc", F.col("doc") % 3, F.col("doc") + 1000, "doc", F.col("doc") * 250)
    return docs.select("doc", F.concat(head, F.array_join(F.transform("all", lambda x: x["xml"]), ""), F.lit("</universe></savegame>")).alias("value"))


def written(docs: DataFrame) -> DataFrame:
    """The elements of documents, written as a file each and read from there."""
    path = folder(docs.sparkSession)
    docs.write.partitionBy("doc").text(path)
    return T.kept(X.elements(docs.sparkSession, path, suffixes=(".txt",)), f"{path}-elements")


DOC_SQL = f"""own AS (SELECT l.*, s_suppkey // {BLOCK} AS doc, 'Ware_' || (l_partkey % 7) AS ware, l_quantity::INT AS amount FROM lineitem AS l JOIN supplier ON s_suppkey = l_suppkey),
 kept AS (SELECT *, 'G' || (doc % 3) AS guid FROM own WHERE doc % 2 = 0 OR l_quantity > 25),
 doc AS (SELECT DISTINCT s_suppkey // {BLOCK} AS doc, 'G' || (s_suppkey // {BLOCK} % 3) AS guid FROM supplier),
 st AS (SELECT s_suppkey, s_nationkey, s_suppkey // {BLOCK} AS doc, 'G' || (s_suppkey // {BLOCK} % 3) AS guid FROM supplier)"""


@query(f"WITH {DOC_SQL} SELECT guid, doc + 1000.5::DOUBLE AS game_time, doc::VARCHAR AS save_date FROM doc")
def src02_headers(spark, sf_dir):
    docs = documents(spark, sf_dir)
    docs.write.partitionBy("doc").text(path := folder(spark))
    return X.peek(spark, path, suffixes=(".txt",)).select("guid", "game_time", "save_date")


@query(f"""WITH {DOC_SQL} SELECT guid, doc + 1000.5::DOUBLE AS game_time, l_suppkey AS station, lower(ware) AS ware, 'held' AS what, sum(amount)::DOUBLE AS amount FROM kept WHERE l_linenumber <= 2 GROUP BY ALL
 UNION ALL SELECT guid, doc + 1000.5::DOUBLE, l_suppkey, lower(ware), 'limit ' || CASE l_linenumber WHEN 5 THEN 'max' ELSE 'sell' END, arg_max(amount, (l_orderkey, l_partkey, l_quantity))::DOUBLE FROM kept WHERE l_linenumber IN (5, 6) GROUP BY ALL
 UNION ALL SELECT guid, doc + 1000.5::DOUBLE, l_suppkey, l_returnflag, 'workers', sum(amount)::DOUBLE FROM kept WHERE l_linenumber = 4 GROUP BY ALL
 UNION ALL SELECT guid, doc + 1000.5::DOUBLE, l_suppkey, lower(ware), CASE WHEN l_returnflag = 'R' THEN 'supplies' ELSE 'offers' END, ROUND(sum(round(l_extendedprice * 100) / 100), 2) FROM kept WHERE l_linenumber = 3 GROUP BY ALL
 UNION ALL SELECT guid, doc + 1000.5::DOUBLE, s_suppkey, 'sec_' || s_nationkey || '_macro', CASE WHEN s_nationkey % 3 = 0 THEN 'at player' ELSE 'at npc' END, -s_suppkey::DOUBLE FROM st WHERE s_suppkey % 13 <> 0""")
def snk05_world_tables(spark, sf_dir):
    """Documents are imported with part of their lines, those of even number once more with all; the tables then hold the later import of each."""
    store = S.Snapshots(spark, folder(spark))
    names = ["component", "cargo", "ware_limit", "workforce", "trade_offer"]
    for docs in (documents(spark, sf_dir, "l_quantity > 25"), documents(spark, sf_dir).filter("doc % 2 = 0")):
        elems = written(docs)
        store.write(T.world(elems, names), T.header(elems))
    saves = store.snapshots().select("save_id", "guid", "game_time")
    station = F.substring(F.col("station"), 2, 20).cast("long").alias("station")
    rows = lambda name, key, ware, what, amount, where="true": store.read(name).filter(where).join(saves, "save_id").select("guid", "game_time", F.col(key).alias("station"), ware.alias("ware"), what.alias("what"), amount.cast("double").alias("amount"))
    low = F.lower(F.col("ware"))
    every = [
        rows("cargo", "object_id", low, F.lit("held"), F.col("amount")),
        rows("ware_limit", "object_id", low, F.concat(F.lit("limit "), "kind"), F.col("amount")),
        rows("workforce", "station_id", F.col("race"), F.lit("workers"), F.col("amount")),
        rows("trade_offer", "object_id", low, F.when(F.col("flags") == "supplies", "supplies").otherwise("offers"), F.col("price_cr")).groupBy("guid", "game_time", "station", "ware", "what").agg(F.round(F.sum("amount"), 2).alias("amount")),
        rows("component", "id", F.col("sector_macro"), F.concat(F.lit("at "), "owner"), F.col("sz"), "class = 'station'"),
    ]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out.withColumn("station", station)


@query(f"WITH {DOC_SQL} SELECT guid, 'sec_' || s_nationkey || '_macro' AS sector_macro, CASE WHEN s_nationkey % 3 = 0 THEN 'player' ELSE 'npc' END AS owner, count(*) AS n FROM st WHERE s_suppkey % 13 <> 0 GROUP BY ALL")
def snk07_presence_once(spark, sf_dir):
    """Counts of each snapshot's stations, added once: the second import of the same documents adds nothing."""
    store = S.Snapshots(spark, folder(spark))
    docs = documents(spark, sf_dir)
    for part in (docs.filter("doc % 2 = 0"), docs):
        elems = written(part)
        store.write(T.world(elems, ["component"]), T.header(elems))
        found = store.aggregate("presence", S.presence(store.read("component")))
    return found.join(store.snapshots().select("save_id", "guid"), "save_id").groupBy("guid", "sector_macro", "owner").agg(F.sum("n").alias("n"))


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """World and reference tables made from the driver's: suppliers are components of two snapshots, lineitems what they hold and do."""
    s, l, c, n, p = (table(spark, sf_dir, t) for t in ("supplier", "lineitem", "customer", "nation", "part"))
    k, at, q = F.col("s_suppkey"), F.col("s_nationkey"), F.col("l_quantity").cast("double")
    kind = F.when(k % 4 == 0, "buildstorage").when(k % 4 == 1, "ship_s").otherwise("station")
    owner = F.when(at % 3 == 0, "player").otherwise(F.concat(F.lit("f"), at))
    two = F.explode(F.when(k % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    component = s.select(two.alias("save_id"), k.alias("id"), F.when(k % 5 != 0, k + 1000).alias("entity_id"), kind.alias("class"), F.concat(F.lit("m"), k % 6).alias("macro"), F.when(k % 7 != 0, F.col("s_name")).alias("name"), F.when(k % 2 == 0, "Base").alias("basename"), F.concat(F.lit("C-"), k).alias("code"), owner.alias("owner"), F.concat(F.lit("sec"), at).alias("sector_macro"), k.alias("spawntime"))
    line = lambda number: l.filter(F.col("l_linenumber") == number).withColumns({"save_id": F.when(F.col("l_partkey") % 9 == 0, 1).otherwise(2), "ware": F.col("l_partkey") % 30, "amount": q, "object": F.col("l_suppkey")})
    task = line(4).select("save_id", F.col("object").alias("host_id"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("task_id"), F.explode(F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("task"), F.lit("progress"))).otherwise(F.array(F.lit("task")))).alias("kind"), F.when(F.col("l_returnflag") == "A", "expand").otherwise("build").alias("type"), F.when(F.col("l_partkey") % 8 != 0, F.col("l_partkey") % 120).alias("target_id"), F.when(F.col("l_orderkey") % 2 == 0, "queued").otherwise("inprogress").alias("ctx"), q.alias("time"), "l_orderkey")
    none = F.lit(None).cast("string")
    task = task.distinct().withColumns({"target_class": none, "target_macro": F.concat(F.lit("t"), F.col("target_id") % 5), "target_code": none, "builder": none, "faction": none, "flags": none, "state": F.when(F.col("kind") == "progress", "busy"), "step": F.lit(1.0), "steps": F.lit(3.0), "method": none, "sequence_index": F.lit(None).cast("double"), "start_time": F.lit(None).cast("double"), "end_time": F.lit(None).cast("double")})
    skill = F.explode(F.array(*[F.struct(F.lit(x).alias("skill"), ((F.col("c_custkey") * (j + 3)) % 16).cast("double").alias("value")) for j, x in enumerate(V.SKILLS)]))
    return {
        "save": spark.createDataFrame([(1, 1000.0), (2, 2000.0)], "save_id int, game_time double"),
        "component": component,
        "sector": n.filter("n_nationkey % 6 <> 0").select(F.concat(F.lit("sec"), "n_nationkey").alias("macro"), F.col("n_name").alias("name")),
        "faction": n.filter("n_nationkey % 4 <> 0").select(F.concat(F.lit("f"), "n_nationkey").alias("id"), F.upper(F.substring("n_name", 1, 3)).alias("shortname")),
        "model": spark.createDataFrame([("m1", "Kestrel"), ("m5", "Heron")], "macro string, model string"),
        "ware": p.select((F.col("p_partkey") % 30).alias("id")).distinct().filter("id < 25").select("id", F.concat(F.lit("Ware "), "id").alias("name"), F.when(F.col("id") % 6 != 0, 1.0 + F.col("id") % 5).alias("volume")),
        "entity": c.select((F.col("c_custkey") + 1000).alias("entity_id"), F.col("c_custkey").cast("double").alias("first_seen"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") + 500.0).alias("gone_time")),
        "build_entry": line(1).select("save_id", F.col("object").alias("host_id"), F.col("l_partkey").alias("entry_id"), (F.col("l_partkey") % 2).cast("int").alias("built")),
        "workforce": line(2).select("save_id", F.col("object").alias("station_id"), "amount"),
        "cargo": line(3).select("save_id", F.col("object").alias("object_id"), "ware", "amount"),
        "fleet_edge": s.select(F.lit(2).alias("save_id"), k.alias("follower"), F.floor(k / 10).cast("long").alias("leader")),
        "build_method": s.filter("s_suppkey % 6 = 0").select(F.lit(2).alias("save_id"), k.alias("object_id"), F.lit("own").alias("method")),
        "faction_meta": n.filter("n_nationkey % 5 = 1").select(F.lit(2).alias("save_id"), F.concat(F.lit("f"), "n_nationkey").alias("faction"), F.lit("rule").alias("build_method")),
        "build_task": task,
        "station_supply": line(5).select("save_id", F.col("object").alias("object_id"), "ware", F.when(F.col("l_returnflag") == "R", "ware").otherwise("order").alias("kind"), "amount"),
        "trade_offer": line(6).select("save_id", F.col("object").alias("object_id"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), "ware", "amount", F.when(F.col("l_partkey") % 3 == 0, F.col("amount") * 2).alias("desired"), F.when(F.col("l_returnflag") == "N", "a|SUPPLIES").otherwise("a").alias("flags")),
        "trade_pending": line(7).select("save_id", F.col("l_orderkey").alias("trade_id"), "ware", "amount", F.col("object").alias("buyer_id"), (F.col("object") % 50).alias("seller_id"), (F.col("l_partkey") % 200).alias("ship_id")),
        "npc": c.select(F.lit(2).alias("save_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "npc_skill": c.filter("c_custkey % 4 <> 0").select(F.lit(2).alias("save_id"), F.col("c_custkey").alias("npc_id"), skill.alias("s")).select("save_id", "npc_id", "s.*").filter("value > 2"),
        "station_storage": line(2).select("save_id", F.col("object").alias("station_id"), "ware", F.col("amount").alias("max_units")),
        "station_munition": line(3).select("save_id", F.col("object").alias("station_id"), (F.col("l_partkey") % 2).cast("int").alias("is_unit"), F.col("l_partkey").alias("macro"), "amount"),
    }


FRAMES_SQL = """component AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey + 1000 END AS entity_id, CASE s_suppkey % 4 WHEN 0 THEN 'buildstorage' WHEN 1 THEN 'ship_s' ELSE 'station' END AS class, 'm' || (s_suppkey % 6) AS macro, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Base' END AS basename, 'C-' || s_suppkey AS code, CASE WHEN s_nationkey % 3 = 0 THEN 'player' ELSE 'f' || s_nationkey END AS owner, 'sec' || s_nationkey AS sector_macro, s_suppkey AS spawntime FROM supplier),
 sector AS (SELECT 'sec' || n_nationkey AS macro, n_name AS name FROM nation WHERE n_nationkey % 6 <> 0), faction AS (SELECT 'f' || n_nationkey AS id, upper(left(n_name, 3)) AS shortname FROM nation WHERE n_nationkey % 4 <> 0),
 ware AS (SELECT DISTINCT p_partkey % 30 AS id, 'Ware ' || (p_partkey % 30) AS name, CASE WHEN p_partkey % 30 % 6 <> 0 THEN 1.0::DOUBLE + p_partkey % 30 % 5 END AS volume FROM part WHERE p_partkey % 30 < 25),
 line AS (SELECT *, l_partkey % 30 AS ware, l_quantity::DOUBLE AS amount, l_suppkey AS object FROM lineitem WHERE l_partkey % 9 <> 0),
 task AS (SELECT DISTINCT object AS host_id, l_orderkey * 100000 + l_partkey AS task_id, l_partkey % 2 = 0 AS busy, CASE WHEN l_returnflag = 'A' THEN 'expand' ELSE 'build' END AS type, CASE WHEN l_partkey % 8 <> 0 THEN l_partkey % 120 END AS target_id, CASE WHEN l_orderkey % 2 = 0 THEN 'queued' ELSE 'inprogress' END AS ctx, l_quantity::DOUBLE AS time, l_orderkey FROM line WHERE l_linenumber = 4)"""


@query("SELECT count(*) AS n, 2 AS save_id, 2000.0::DOUBLE AS game_time FROM supplier")
def vw01_current_save(spark, sf_dir):
    f = frames(spark, sf_dir)
    return V.current(f, "component").agg(F.count("*").alias("n")).join(V.current_save(f), F.lit(True))


@query(f"WITH {FRAMES_SQL} SELECT c.id, s.name AS sector_name, f.shortname AS owner_code, coalesce(c.name, CASE c.macro WHEN 'm1' THEN 'Kestrel' WHEN 'm5' THEN 'Heron' END, f.shortname || ' ' || coalesce(basename, 'Station')) AS display_name FROM component c LEFT JOIN sector s ON s.macro = c.sector_macro LEFT JOIN faction f ON f.id = c.owner")
def vw04_universe_view(spark, sf_dir):
    return V.universe(frames(spark, sf_dir)).select("id", "sector_name", "owner_code", "display_name")


@query(f"WITH {FRAMES_SQL}, e AS (SELECT c_custkey + 1000 AS entity_id, c_custkey::DOUBLE AS first_seen, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 500.0 END::DOUBLE AS gone_time FROM customer) SELECT e.entity_id, coalesce(gone_time, 2000) - first_seen AS observed_span_s, gone_time IS NULL AS alive, c.id AS component_id, c.sector_macro FROM e LEFT JOIN component c USING (entity_id)")
def vw09_entity_life_view(spark, sf_dir):
    return V.entity_life(frames(spark, sf_dir)).select("entity_id", "observed_span_s", "alive", "component_id", "sector_macro")


@query(f"WITH {FRAMES_SQL} SELECT c.id, s.name AS sector_name, (SELECT count(*) FROM line WHERE object = c.id AND l_linenumber = 1 AND l_partkey % 2 = 1) AS modules_built, (SELECT sum(amount) FROM line WHERE object = c.id AND l_linenumber = 2) AS workforce, (SELECT sum(amount * coalesce(volume, 0)) FROM line LEFT JOIN ware ON ware.id = line.ware WHERE object = c.id AND l_linenumber = 3) AS cargo_volume_m3 FROM component c LEFT JOIN sector s ON s.macro = c.sector_macro WHERE class = 'station'")
def vw10_station_view(spark, sf_dir):
    return V.station(frames(spark, sf_dir)).select("id", "sector_name", "modules_built", "workforce", "cargo_volume_m3")


@query(f"WITH {FRAMES_SQL} SELECT a.id AS follower_id, a.entity_id AS follower_entity, b.id AS commander_id, b.entity_id AS commander_entity FROM component a JOIN component b ON b.id = a.id // 10 WHERE a.owner = 'player' AND b.owner = 'player'")
def vw11_player_fleet_view(spark, sf_dir):
    return V.player_fleet(frames(spark, sf_dir))


@query(f"WITH {FRAMES_SQL} SELECT id AS object_id, owner, CASE WHEN id % 6 = 0 THEN 'own' ELSE 'rule' END AS method, CASE WHEN id % 6 = 0 THEN 'station' ELSE 'faction' END AS source FROM component WHERE class <> 'ship_s' AND (id % 6 = 0 OR owner IN (SELECT 'f' || n_nationkey FROM nation WHERE n_nationkey % 5 = 1))")
def vw13_build_method_view(spark, sf_dir):
    return V.build_method(frames(spark, sf_dir))


@query(f"WITH {FRAMES_SQL} SELECT host_id, task_id, h.code AS host_code, h.class AS host_class, t.target_id, c.name AS target_name, c.spawntime AS target_spawntime, CASE WHEN p.busy THEN 'busy' END AS state FROM task t LEFT JOIN component h ON h.id = host_id LEFT JOIN component c ON c.id = t.target_id LEFT JOIN (SELECT host_id, task_id, busy FROM task WHERE busy) p USING (host_id, task_id)")
def vw14_build_task_view(spark, sf_dir):
    return V.build_task(frames(spark, sf_dir)).select("host_id", "task_id", "host_code", "host_class", "target_id", "target_name", "target_spawntime", "state")


@query(f"WITH {FRAMES_SQL}, x AS (SELECT host_id AS storage_id, target_id AS station_id, min(ctx) AS ctx, min(time) AS time, count(*) AS n_tasks FROM task WHERE type = 'expand' AND target_id IS NOT NULL GROUP BY ALL) SELECT x.*, 't' || (station_id % 5) AS station_macro, s.code AS storage_code, s.owner, c.code AS station_code, c.name AS station_name, c.sector_macro FROM x LEFT JOIN component s ON s.id = storage_id LEFT JOIN component c ON c.id = station_id")
def vw15_storage_station_view(spark, sf_dir):
    return V.build_storage_station(frames(spark, sf_dir))


@query(f"WITH {FRAMES_SQL} SELECT object AS object_id, CASE WHEN l_returnflag = 'R' THEN 'ware' ELSE 'order' END AS kind, line.ware, amount, c.code AS station_code, c.name AS station_name, c.owner, w.name AS ware_name FROM line LEFT JOIN component c ON c.id = object LEFT JOIN ware w ON w.id = line.ware WHERE l_linenumber = 5")
def vw16_station_supply_view(spark, sf_dir):
    return V.station_supply(frames(spark, sf_dir))


@query(f"WITH {FRAMES_SQL}, h AS (SELECT object, ware, sum(amount) AS held FROM line WHERE l_linenumber = 5 AND l_returnflag = 'R' GROUP BY ALL), o AS (SELECT object, ware, sum(CASE WHEN l_partkey % 3 = 0 THEN amount * 2 ELSE amount END) AS on_order FROM line WHERE l_linenumber = 6 AND l_linestatus = 'O' AND l_returnflag = 'N' GROUP BY ALL) SELECT object AS object_id, x.ware, c.code AS station_code, c.name AS station_name, c.owner, w.name AS ware_name, coalesce(held, 0) AS held, coalesce(on_order, 0) AS on_order, coalesce(held, 0) + coalesce(on_order, 0) AS allocation FROM (SELECT * FROM h FULL JOIN o USING (object, ware)) x LEFT JOIN component c ON c.id = object LEFT JOIN ware w ON w.id = x.ware")
def vw17_supply_position_view(spark, sf_dir):
    return V.supply_position(frames(spark, sf_dir))


@query(f"WITH {FRAMES_SQL} SELECT l_orderkey AS trade_id, line.ware, amount, w.name AS ware_name, b.code AS buyer_code, b.owner AS buyer_faction, s.code AS seller_code, s.owner AS seller_faction, x.code AS ship_code FROM line LEFT JOIN ware w ON w.id = line.ware LEFT JOIN component b ON b.id = object LEFT JOIN component s ON s.id = object % 50 LEFT JOIN component x ON x.id = l_partkey % 200 WHERE l_linenumber = 7")
def vw18_trade_pending_view(spark, sf_dir):
    return V.trade_pending(frames(spark, sf_dir)).select("trade_id", "ware", "amount", "ware_name", "buyer_code", "buyer_faction", "seller_code", "seller_faction", "ship_code")


@query(f"WITH {FRAMES_SQL} SELECT object AS host_id, l_partkey AS entry_id FROM line WHERE l_linenumber = 1 AND l_partkey % 2 = 1")
def vw19_built_module_view(spark, sf_dir):
    return V.built_module(frames(spark, sf_dir)).select("host_id", "entry_id")


@query("WITH v AS (SELECT c_custkey AS id, c_name AS name, " + ", ".join(f"CASE WHEN c_custkey % 4 <> 0 AND c_custkey * {j + 3} % 16 > 2 THEN c_custkey * {j + 3} % 16 END::DOUBLE AS {x}" for j, x in enumerate(V.SKILLS)) + " FROM customer) SELECT * FROM v")
def vw20_npc_view(spark, sf_dir):
    return V.npc(frames(spark, sf_dir))


@query(f"WITH {FRAMES_SQL} SELECT object AS station_id, line.ware, amount AS max_units, c.code AS station_code, c.name AS station_name, s.name AS sector_name, w.name AS ware_name FROM line LEFT JOIN component c ON c.id = object LEFT JOIN sector s ON s.macro = c.sector_macro LEFT JOIN ware w ON w.id = line.ware WHERE l_linenumber = 2")
def vw21_station_storage_view(spark, sf_dir):
    return V.station_storage(frames(spark, sf_dir))


@query(f"WITH {FRAMES_SQL} SELECT object AS station_id, (l_partkey % 2)::INT AS is_unit, l_partkey AS macro, amount, c.code AS station_code, c.name AS station_name, c.owner, s.name AS sector_name FROM line LEFT JOIN component c ON c.id = object LEFT JOIN sector s ON s.macro = c.sector_macro WHERE l_linenumber = 3")
def vw22_station_munition_view(spark, sf_dir):
    return V.station_munition(frames(spark, sf_dir))


@query(f"WITH {FRAMES_SQL} SELECT object AS station_id, l_partkey AS macro, c.owner FROM line LEFT JOIN component c ON c.id = object WHERE l_linenumber = 3 AND l_partkey % 2 = 1")
def vw23_station_drones_view(spark, sf_dir):
    return V.station_drones(frames(spark, sf_dir)).select("station_id", "macro", "owner")


@query("SELECT count(*) AS n, count(*) FILTER (d IS NULL) AS firsts, ROUND(sum(greatest(d, 0)), 2) AS dv, ROUND(sum(greatest(-d, 0)), 2) AS dv_neg FROM (SELECT d FROM (SELECT value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS d FROM events)) WHERE true")
def vw08_stock_delta(spark, sf_dir):
    from orrery.operators import windows as W

    from .roles import stock

    flow = V.stock_delta(W.flows(stock(spark, sf_dir), ["owner", "ware"], ["t", "ord"], "level"))
    return flow.agg(F.count("*").alias("n"), F.count(F.when(F.col("dv").isNull(), 1)).alias("firsts"), r(F.sum("dv"), 2).alias("dv"), r(F.sum("dv_neg"), 2).alias("dv_neg"))


@query("SELECT 1 AS turn, true AS written, count(*) AS n, sum(p_size)::BIGINT AS total FROM part UNION ALL SELECT 2, false, count(*), sum(p_size)::BIGINT FROM part UNION ALL SELECT 3, true, count(*), (sum(p_size) + 1)::BIGINT FROM part")
def snk04_reference(spark, sf_dir):
    """Parts as a reference table: written, then in another order, then with one value changed."""
    p, root = table(spark, sf_dir, "part"), folder(spark)
    first = p.agg(F.min("p_partkey")).first()[0]
    out = None
    for turn, df in enumerate((p, p.repartition(7, "p_name"), p.withColumn("p_size", F.col("p_size") + (F.col("p_partkey") == first).cast("int"))), 1):
        written = S.put_reference(df, root, "part")
        row = S.reference(spark, root, "part").agg(F.lit(turn).alias("turn"), F.lit(written).alias("written"), F.count("*").alias("n"), F.sum("p_size").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out
