"""World tables of documents written by hand, and imports that replace each other."""

import pytest
from pyspark.sql import functions as F

from orrery.sources import snapshot_tables as T
from orrery.sources import snapshot_xml as X
from orrery.streaming import snapshots as S

from .test_snapshot_xml import DOC

MORE = """<savegame><info><save date="8"/><game guid="G1" time="90"/><player name="Kay" money="500"/></info><universe>
<factions><faction id="Red"><account amount="12300"/><buildrules method="ClosedLoop"/></faction><faction id="blue"><account amount="50"/></faction></factions>
<component class="sector" macro="S_Macro" id="[1]" connection="c">
 <component class="station" macro="St" id="[2]" code="OLD" connection="c"/><component class="station" macro="St" id="[2]" code="NEW" owner="red" connection="c"><component class="module" construction="e1" id="[m]"/><component class="module" construction="e2" state="construction" id="[n]"/>
  <construction><sequence><entry index="1" macro="Mod_A" id="e1"/><entry index="2" macro="Mod_B" id="e2"/><entry index="1" macro="Mod_Z" id="e1"/><entry index="3" macro="Mod_C"/></sequence></construction>
  <component class="production" macro="Prod_A" id="[p]"><production state="on"><queue ware="ore"/><efficiency product="1.5"/></production></component><component class="production" macro="Prod_A" id="[q]"><production state="on"><queue ware="ore"/><efficiency product="1.5"/></production></component>
  <component class="storage" id="[s]"><cargo><ware ware="ore" amount="7"/></cargo></component><component class="storage" id="[t]"><cargo><ware ware="ore" amount="5"/></cargo></component>
  <build type="expand" id="[k]" component="[2]"/><component class="npc" id="[z]" owner="player" name="Ann"><skills piloting="9" morale="x"/></component>
  <trade><prices><reference><ware ware="Ore" buy="5" sell="0"/><ware ware="ore" buy="6" sell="0"/></reference></prices></trade></component>
 <component class="ship_s" id="[3]" owner="player" connection="c"><component class="engine" macro="E1"/><component class="engine" macro="e1"/></component><component class="ship_m" id="[4]" owner="red" connection="c"><component class="engine" macro="e1"/></component><component class="ship_m" id="[5]" owner="player"/>
 <component class="datavault" id="[v]" macro="landmarks_vault_1_macro" connection="c"><offset><position x="3" z="4"/></offset><unlock state="unlocked"/><component class="collectablewares" id="[w]"/><component class="collectableblueprints" id="[x]" blueprints="bp1,bp2"/></component>
</component></universe></savegame>"""


@pytest.fixture(scope="module")
def elems(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("world")
    (d / "a.xml").write_text(DOC)
    (d / "b.xml").write_text(MORE)
    return T.kept(X.elements(spark, str(d)), str(tmp_path_factory.mktemp("elems")))


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.filter("file LIKE '%b.xml'").collect()), key=repr)


def test_world_tables(elems):
    w = T.world(elems)
    assert set(w) == set(T.TABLES) and all("file" in df.columns and "ord" not in df.columns for df in w.values())
    assert got(w["component"], "id", "code") == [("[1]", None), ("[2]", "NEW"), ("[3]", None), ("[4]", None)]  # the last of a key; none without a connection
    assert got(w["build_entry"], "entry_id", "macro", "built") == [("e1", "mod_a", 1), ("e2", "mod_b", 0), (None, "mod_c", 1)]
    assert got(w["module_production"], "object_id", "macro", "ware", "efficiency", "state", "n_modules") == [("[2]", "prod_a", "ore", 1.5, "on", 2)]
    assert got(w["cargo"], "object_id", "ware", "amount") == [("[2]", "ore", 12.0)]
    assert got(w["build_task"], "task_id", "type", "target_id", "target_code") == [("[k]", "expand", "[2]", "NEW")]
    assert got(w["npc_skill"], "npc_id", "skill", "value") == [("[z]", "morale", None), ("[z]", "piloting", 9.0)]
    assert got(w["price_setting"], "ware", "buy", "sell") == [("ore", 6.0, None)]
    assert got(w["ship_engine"], "object_id", "macro", "n") == [("[3]", "e1", 2)]  # of the player's ships
    assert got(w["datavault"], "object_id", "sector_macro", "sx", "sz", "unlocked", "loot", "blueprints") == [("[v]", "s_macro", 3.0, 4.0, 1, 2, "bp1,bp2")]
    assert got(w["faction_meta"], "faction", "account_cr", "build_method") == [("blue", 0.5, None), ("red", 123.0, "closedloop")]
    assert got(T.header(elems), "guid", "game_time", "save_date", "player_name", "player_money_cr") == [("G1", 90.0, "8", "Kay", 5.0)]
    counts = {k: df.filter("file LIKE '%a.xml'").count() for k, df in w.items()}
    assert {k: n for k, n in counts.items() if n} == {"component": 5, "fleet_edge": 1, "workforce": 1, "people": 2, "cargo": 2, "trade_offer": 1, "ship_order": 1, "datavault": 2, "faction_relation": 2, "build_method": 1, "player_stat": 1, "station_trade_setting": 2, "trade_pending": 1}


def test_imports_replace_each_other(spark, elems, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "store"))
    assert store.ledger().count() == 0 and store.current().count() == 0
    first = {k: df.filter("file LIKE '%a.xml'") for k, df in T.world(elems, ["component", "cargo"]).items()}
    head = T.header(elems)
    store.write(first, head.filter("file LIKE '%a.xml'"))
    store.write(T.world(elems, ["component", "cargo"]), head)  # a again, and b
    assert [(r.save_id, r.snapshot, r.guid, r.game_time) for r in store.ledger().orderBy("save_id").collect()] == [(1, 1, "G1", 86.25), (2, 1, "G1", 86.25), (3, 3, "G1", 90.0)]
    assert [(r.save_id, r.player_money_cr) for r in store.snapshots().orderBy("save_id").collect()] == [(1, 1.23), (3, 5.0)]
    assert store.current().first().save_id == 3
    count = lambda name, **o: {r.save_id: r["count"] for r in store.read(name, **o).groupBy("save_id").count().collect()}
    assert count("component") == {1: 5, 3: 4} and count("component", current=True) == {3: 4} and count("cargo") == {1: 2, 3: 1}
    store.write({"component": first["component"].filter("class = 'station'"), "cargo": first["cargo"].limit(0)}, head.filter("file LIKE '%a.xml'"))
    assert count("component") == {1: 1, 3: 4} and count("cargo") == {3: 1}  # all tables of the snapshot at once
    assert store.current().first().save_id == 1
    store.clean(["component", "cargo"])
    assert count("component") == {1: 1, 3: 4}
    with pytest.raises(ValueError):
        store.read("none")


def test_an_import_that_breaks_off_does_not_count(spark, elems, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "store"))
    head, tables = T.header(elems), T.world(elems, ["component"])
    store.write(tables, head)
    before = sorted(map(tuple, store.read("component").collect()), key=repr)
    with pytest.raises(Exception):
        store.write({"component": tables["component"].limit(1), "cargo": spark.range(1).selectExpr("'x' AS file", "raise_error('stop') AS y")}, head)
    assert sorted(map(tuple, store.read("component").collect()), key=repr) == before


def test_aggregates_are_added_once(spark, elems, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "store"))
    head, tables = T.header(elems), T.world(elems, ["component", "trade_offer"])
    for _ in range(2):
        store.write(tables, head)
        presence = store.aggregate("presence", S.presence(store.read("component")))
        books = store.aggregate("market", S.market(store.read("component"), store.read("trade_offer")))
    assert sorted((r.save_id, r["class"], r.owner, r.n) for r in presence.collect()) == [(1, "ship_l", "player", 1), (1, "ship_s", "player", 1), (1, "station", "red", 1), (2, "ship_m", "red", 1), (2, "ship_s", "player", 1), (2, "station", "red", 1)]
    assert [(r.sector_macro, r.ware, r.side, r.n, r.price_avg) for r in books.collect()] == [("s1_macro", "ore", "buy", 1, 12.34)]


def test_many_snapshots_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FOLDERS", 2)
    store = S.Snapshots(spark, str(tmp_path / "store"))
    rows = lambda *n: spark.createDataFrame([(f"f{k}", f"c{k}") for k in n for _ in range(2)], "file string, code string")
    heads = lambda *n: spark.createDataFrame([(f"f{k}", f"G{k}", float(k), "1") for k in n], "file string, guid string, game_time double, save_date string")
    folders = lambda: sorted(p.parent.name + "/" + p.name for p in (tmp_path / "store").rglob("part=*"))
    rows(7).withColumn("save_id", F.lit(1)).drop("file").write.partitionBy("save_id").parquet(str(tmp_path / "store" / "component" / "v=1"))  # as imports once were
    heads(7).withColumns({"seq": F.lit(1), "save_id": F.lit(1), "snapshot": F.lit(1)}).selectExpr(*[f"cast({c} AS {t}) AS {c}" for c, t in (x.split() for x in S.LEDGER.split(", ")) if c in ("seq", "save_id", "snapshot", "file", "guid", "game_time", "save_date")]).write.parquet(str(tmp_path / "store" / "_ledger"))
    store.write({"component": rows(1, 2, 3, 4, 5)}, heads(1, 2, 3, 4, 5))
    assert folders() == ["v=2/part=0", "v=2/part=1"]
    store.write({"component": rows(4, 5)}, heads(4, 5))
    found = {(r.save_id, r.code): r["count"] for r in store.read("component").groupBy("save_id", "code").count().collect()}
    assert found == {(1, "c7"): 2} | {(k + 1, f"c{k}"): 2 for k in range(1, 6)}
    assert {r.code for r in store.read("component", current=True).collect()} == {"c5"}
    store.clean(["component"])
    assert folders() == ["v=2/part=0", "v=3/part=0", "v=3/part=1"]  # those of 4 and 5 were replaced
    assert {(r.save_id, r.code): r["count"] for r in store.read("component").groupBy("save_id", "code").count().collect()} == found
