import gzip
import io
import os

import pytest

from orrery.sources import snapshot_source as S
from orrery.sources import snapshot_xml as X

DOC = """<savegame>
<info><save date="7"/><game guid="G1" version="731" time="86.25"/><player name="Kay" money="123"/></info>
<universe>
 <factions><faction id="red"><relations><relation faction="blue" relation="0.25"/><booster faction="blue" relation="-0.5" time="9"/></relations></faction></factions>
 <component class="cluster" macro="C1_macro" id="[1]" connection="c"><connections><connection connection="x">
  <component class="sector" macro="S1_macro" id="[2]" connection="c"><connections><connection connection="zones">
   <component class="zone" id="[3]"><offset><position x="1000" z="2000"/></offset><connections><connection connection="y">
    <component class="station" macro="St_macro" id="[10]" code="ABC-123" owner="red" connection="z" spawntime="3.5"><offset><position x="10" z="-20"/></offset>
     <workforces><workforce race="split" amount="40"/></workforces><trade><offers><production><trade id="[t1]" buyer="[10]" ware="ore" amount="50" price="1234" desired="80" flags="supplies"/></production></offers>
      <settings><setting name="buy" wares="ore ice"/></settings><reservations><reservation id="[p1]" reserver="[20]" buyer="[10]" partner="[30]" ware="ore" amount="5" price="200"/></reservations><active><trade id="[p1]"/></active></trade>
     <ammunition><available><item macro="Drone_M" amount="3"/></available></ammunition><build method="closedloop"><ship absolute="1"/></build>
     <component class="storage" id="[11]"><cargo><ware ware="ore" amount="7"/><ware ware="ice"/></cargo></component>
     <component class="ship_s" macro="Ship_m" id="[20]" owner="player" connection="d"><connections><connection connection="commander" id="[k]"><connected connection="[sub]"/></connection></connections>
      <people><person role="marine"/><person role="marine"/><person/></people><ammunition><available><item macro="Drone_M" amount="9"/></available></ammunition>
      <orders><order id="1" order="TradePerform" default="1"><trade id="[p1]" buyer="[10]" seller="[30]" ware="ore" amount="5" price="200"/></order></orders></component>
    </component></connection></connections></component>
   <component class="datavault" id="[40]" macro="Landmarks_Vault_07_macro"><unlock state="unlocked"/></component><component class="object" id="[41]" macro="landmarks_erlking_vault_2_macro"/><component class="object" id="[42]" macro="landmarks_wreck_3_macro"/><component class="object" id="[43]" macro="old_datavault"/>
   <component class="ship_l" id="[30]" owner="player" connection="e"><connections><connection connection="subordinates" id="[sub]"/></connections><stats><stat id="kills" value="99"/></stats></component>
   </connection></connections><resourceareas><area yieldid="belt_b_ice_thin_quick" yield="4"/><area yieldid="ring_methane_rich" yield="2"/><area yieldid="ring_scrap"/><area yieldid="scrap"/><area yieldid="ring_ore_2"/><area yieldid="belt_of_dust"/></resourceareas></component>
 </connection></connections></component>
</universe>
<economylog><entries type="cargo"><log time="1" type="trade" owner="[10]" ware="ore" v="4"/><log time="1" type="produce" owner="[10]" ware="ore" v="5"/></entries>
 <entries type="trade"><log time="2" type="trade" ware="ore" buyer="[10]" seller="[30]" price="150" v="3"/><log time="3" type="transfer" ware="ore" buyer="[10]" seller="[30]" v="1"/></entries>
 <entries type="money"><log time="2" type="sale" owner="[30]" v="100" v2="250"/></entries><removed><object id="[9]" name="Gone" code="XYZ-001" owner="blue"/></removed></economylog>
<stats><stat id="kills" value="2"/></stats>
<log><entry time="4" category="upkeep" title="Hello"/></log>
</savegame>"""


@pytest.fixture(scope="module")
def elems(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("snap")
    (d / "a.xml").write_text(DOC)
    return X.elements(spark, str(d)).cache()


def one(elems, name, *columns):
    return [tuple(r[c] for c in columns) for r in X.records(elems, name).orderBy("ord").collect()]


def test_records(elems):
    assert one(elems, "component", "id", "cluster_macro", "sector_macro", "parent_id") == [("[1]", "c1_macro", None, None), ("[2]", "c1_macro", "s1_macro", "[1]"), ("[10]", "c1_macro", "s1_macro", "[2]"), ("[20]", "c1_macro", "s1_macro", "[10]"), ("[30]", "c1_macro", "s1_macro", "[2]")]
    assert one(elems, "trade_offer", "object_id", "side", "ware", "amount", "price_cr", "desired") == [("[10]", "buy", "ore", 50.0, 12.34, 80.0)]
    assert one(elems, "trade_setting", "object_id", "setting", "ware") == [("[10]", "buy", "ore"), ("[10]", "buy", "ice")]
    assert one(elems, "cargo", "object_id", "ware", "amount") == [("[10]", "ore", 7.0), ("[10]", "ice", 1.0)]
    assert one(elems, "ammunition", "station_id", "macro", "amount") == [("[10]", "drone_m", 3.0)]
    assert one(elems, "station_build_method", "object_id", "method") == [("[10]", "closedloop")] and one(elems, "build_task", "host_id") == []
    assert one(elems, "datavault", "id", "sector_macro") == [("[40]", "s1_macro"), ("[41]", "s1_macro")] and one(elems, "vault_unlock", "id") == [("[40]",)]
    assert one(elems, "player_stat", "id", "value") == [("kills", 2.0)]
    assert one(elems, "workforce", "station_id", "race", "amount") == [("[10]", "split", 40.0)]
    assert one(elems, "ship_order", "object_id", "order", "is_default") == [("[20]", "TradePerform", 1)]
    assert one(elems, "removed_object", "code") == [("XYZ-001",)] and one(elems, "log_entry", "title", "category") == [("Hello", "upkeep")]


def test_joined_records(elems):
    wares = elems.sparkSession.createDataFrame([(w,) for w in ("ore", "ice", "methane", "scrap", "quick")], "ware string").filter("ware <> 'quick'")
    assert [tuple(r)[2:7] for r in X.resources(elems, wares).orderBy("ord").collect()] == [("s1_macro", "ice", 4.0, "thin", "quick"), ("s1_macro", "methane", 2.0, "rich", None), ("s1_macro", "scrap", 0.0, None, None), ("s1_macro", "ore", 0.0, "2", None)]
    assert [(r.follower, r.leader, r.conflict) for r in X.fleet_edges(elems).collect()] == [("[20]", "[30]", False)]
    at = {r.ord: (r.sx, r.sz) for r in X.positions(elems).collect()}
    ids = {r.id: r.ord for r in X.records(elems, "component").collect()}
    assert at[ids["[10]"]] == (1010.0, 1980.0) and at[ids["[20]"]] == (1010.0, 1980.0) and at[ids["[30]"]] == (0.0, 0.0)
    assert {(r.object_id, r.role, r.n) for r in X.crew(elems).collect()} == {("[20]", "marine", 2), ("[20]", "", 1)}
    assert {(r.kind, r.value, r.faction, r.other) for r in X.faction_relations(elems).collect()} == {("base", 0.25, "red", "blue"), ("booster", -0.5, "red", "blue")}
    [p] = X.pending_trades(elems).collect()
    assert (p.trade_id, p.buyer_id, p.seller_id, p.ship_id, p.station_id, p.is_active, p.price_cr) == ("[p1]", "[10]", "[30]", "[20]", "[10]", 1, 2.0)


def test_ledgers_are_typed_by_their_block(elems):
    assert [(r.t, r.level) for r in X.ledger(elems, "cargo").collect()] == [(1.0, 4.0)]
    assert [(r.kind, r.price_cr, r.amount) for r in X.ledger(elems, "trade").orderBy("t").collect()] == [("trade", 1.5, 3.0), ("transfer", None, 1.0)]
    assert [r.amount_cr for r in X.ledger(elems, "money").collect()] == [2.5]


def test_gzip_peek_landmarks_and_broken_files(spark, tmp_path):
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(DOC.encode()))
    (tmp_path / "c.xml").write_text(DOC[: DOC.index("<economylog>")])
    assert {(r.guid, r.game_time, r.save_date) for r in X.peek(spark, str(tmp_path)).collect()} == {("G1", 86.25, "7")} and X.peek(spark, str(tmp_path)).count() == 2
    assert {(r.id, r.sector_macro, r.sx) for r in X.landmarks(spark, str(tmp_path), "ST_M").collect()} == {("[10]", "s1_macro", 1010.0)}
    e = X.elements(spark, str(tmp_path))
    assert e.filter("tag = '#truncated'").count() == 1 and X.records(e, "component").count() == 10


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_a_header_is_read_and_no_more():
    long = DOC.replace("</universe>", "<x a='%s'/>" % ("y" * 5_000_000) + "</universe>")
    for data in (long.encode(), gzip.compress(long.encode(), 0)):
        stream = Counted(data)
        rows = list(X.parse(stream, frozenset({"game", "save", "info"}), "info"))
        assert [r[3] for r in rows] == ["info", "save", "game"] and stream.taken <= 1 << 15


def test_files_beyond_two_gigabytes(spark, tmp_path):
    head = DOC[: DOC.index("<universe>")]
    with open(tmp_path / "big.xml", "wb") as f:  # a hole of 3 GB behind the header
        f.write(head.encode())
        f.truncate(3 << 30)
    assert [(r.guid, r.game_time) for r in X.peek(spark, str(tmp_path)).collect()] == [("G1", 86.25)]


def test_packed_files_of_several_members_and_cut_ones():
    one, two = DOC[:700].encode(), DOC[700:].encode()
    packed = gzip.compress(one) + gzip.compress(two)
    assert list(X.parse(io.BytesIO(packed))) == list(X.parse(io.BytesIO(DOC.encode())))
    bomb = gzip.compress(b"<a>" + b"<b/>" * 3_000_000 + b"</a>")
    assert max(map(len, X.chunks(io.BytesIO(bomb)))) <= X.UNPACKED
    for bad in (packed[:-20], packed[:60] + b"\x00\xff\x00" + packed[63:]):
        assert list(X.parse(io.BytesIO(bad)))[-1][3] == "#truncated"


def test_saves_are_found_by_their_folders(tmp_path):
    old, new = tmp_path / "x" / "123" / "save", tmp_path / "y" / "Game" / "456" / "save"
    for k, (folder, names) in enumerate(((old, ["a.xml.gz"]), (new, ["q.xml", "r.xml.gz", "note.txt"]))):
        folder.mkdir(parents=True)
        for n, name in enumerate(names):
            (folder / name).write_text("<savegame/>")
            os.utime(folder / name, (1000 + 10 * k + n, 1000 + 10 * k + n))
    (tmp_path / "y" / "other").mkdir()
    (tmp_path / "y" / "other" / "z.xml").write_text("<a/>")
    roots = [str(tmp_path / p) for p in ("none", "y", "x")]
    assert [p.rsplit("/", 1)[1] for p in S.saves(roots)] == ["r.xml.gz", "q.xml"] and S.saves(roots[2:]) == [str(old / "a.xml.gz")] and S.saves(roots[:1]) == []
    (new / "temp.xml.gz").write_text("")
    with pytest.raises(RuntimeError):
        S.saves(roots)


def test_other_stores_are_left_to_spark(spark, tmp_path):
    assert S.readable("/a/b") and S.readable("file:///a") and not S.readable("viewfs://x/a")
    (tmp_path / "a.xml").write_text(DOC)
    assert X.elements(spark, f"file://{tmp_path}").count() == X.elements(spark, str(tmp_path)).count()


def test_small_files_share_a_task(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"{k:02}.xml").write_text(DOC)
    (tmp_path / "20.xml").write_text(DOC + " " * S.SHARE)
    e = X.elements(spark, str(tmp_path))
    assert e.rdd.getNumPartitions() == 2 and e.select("file").distinct().count() == 21
    want = list(X.parse(io.BytesIO(DOC.encode())))
    for file in ("/03.xml", "/20.xml"):
        assert [(*r[:5], dict(r.attrs), [c.asDict() for c in r.comps], r.text) for r in e.filter(e.file.endswith(file)).drop("file").orderBy("ord").collect()] == [tuple(x) for x in want]
