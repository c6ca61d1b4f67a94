"""Capacities, connections and gates of small game files, by hand."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import galaxy as G
from orrery.sources import game_files as K
from orrery.sources import patches as P
from orrery.sources import snapshot_xml as X

MACROS = """<macros><macro name="Hab_A" class="habitation"><properties><workforce capacity="100" max="5"/></properties></macro><macro name="store_b" class="storage"><properties><cargo max="900" tags="solid"/><storage unit="4"/></properties></macro><macro name="plain" class="x"><properties/></macro></macros>"""
DIFF = """<diff><replace sel="/macros/macro[@name='Hab_A']/properties/workforce/@capacity">150</replace><replace sel="/macros/macro[@name='none']/properties/workforce/@max">9</replace></diff>"""
SECTORS = """<macros><macro name="Cluster_01_Sector001_macro" class="sector"><connections><connection name="Zone001_connection" ref="zones"><offset><position x="1000" z="-2000"/></offset><macro ref="Zone001_macro" connection="sector"/></connection><connection name="Zone002_connection" ref="zones"><macro ref="zone002_macro"/></connection></connections></macro></macros>"""


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cut")))
    d = tmp_path_factory.mktemp("files")
    for name, text in (("modules-0", MACROS), ("modules-1", DIFF), ("sectors-0", SECTORS)):
        (d / f"{name}.xml").write_text(text)
    part = lambda k: F.regexp_extract("file", r"/(\w+)-(\d)\.xml$", k)
    return P.patched(X.elements(spark, str(d)).withColumns({"doc": part(1), "turn": part(2).cast("int")}))[0].cache()


def test_capacities(nodes):
    got = {r.macro: tuple(r)[1:] for r in K.capacities(nodes).collect()}
    assert got == {"hab_a": ("habitation", 150.0, 5.0, None, None, None), "store_b": ("storage", None, None, 900.0, "solid", 4.0)}


def test_connections(nodes):
    got = [(r.macro, r.ref, r.name, r.target_ref, r.x, r.z) for r in K.connections(nodes).orderBy("place").collect()]
    assert got == [("cluster_01_sector001_macro", "zones", "zone001_connection", "zone001_macro", 1000.0, -2000.0), ("cluster_01_sector001_macro", "zones", "zone002_connection", "zone002_macro", None, None)]


def test_links_of_sectors(spark):
    path = lambda c, s, rest: f"../Cluster_{c}_connection/Cluster_{c}_Sector00{s}_connection/{rest}"
    zones = spark.createDataFrame([("Z1_connection", "ZM1", 100.0, 200.0, 1), ("z1_connection", "zm1", 10.0, 20.0, 2), ("z2_connection", "zm2", 5.0, 5.0, 3)], "name string, macro string, x double, z double, ord long")
    gates = spark.createDataFrame([("zm1", "gate_a", 1.0, 2.0, 1), ("zm1", "gate_b", 3.0, 4.0, 2), ("zm2", None, 7.0, 7.0, 3)], "macro string, name string, x double, z double, ord long")
    jumps = spark.createDataFrame([(1, path(2, 1, "z1_connection/Gate_B"), path(1, 1, "z2_connection/none")), (2, path(1, 1, "zz"), path(2, 1, "zz")), (3, path(1, 1, "z1_connection"), path(1, 1, "z2_connection")), (4, "nowhere", path(1, 1, ""))], "ord long, a_path string, b_path string")
    ways = spark.createDataFrame([(1, path(3, 1, "z1_connection"), path(3, 2, "z1_connection"), "GATE_B", None), (2, path(3, 2, "x"), path(3, 1, "x"), None, None), (3, path(4, 2, ""), path(4, 1, ""), None, None), (4, path(1, 1, ""), path(2, 1, ""), None, None)], "ord long, a_path string, b_path string, a_gate string, b_gate string")
    got = {(r.sector_a, r.sector_b): tuple(r)[2:] for r in G.links(jumps, ways, zones, gates).collect()}
    name = lambda c, s: f"cluster_{c}_sector00{s}_macro"
    assert got == {(name(1, 1), name(2, 1)): (12.0, 12.0, 13.0, 24.0, None), (name(3, 1), name(3, 2)): (13.0, 24.0, 11.0, 22.0, None), (name(4, 1), name(4, 2)): (0.0, 0.0, 0.0, 0.0, name(4, 1))}


def test_straight_tracks_stay_straight(spark):
    points = spark.createDataFrame([("t", 1, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), ("t", 2, 3.0, 0.0, 1.0, 0.0, 1.0, 1.0), ("t", 3, 6.0, 0.0, 1.0, 0.0, 1.0, 0.0), ("lone", 1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "track string, k long, x double, z double, tx double, tz double, inlength double, outlength double")
    got = [(r.track, r.n, round(r.x, 6), r.z) for r in G.tracks(points, 4).orderBy("n").collect()]
    assert [(t, n, z) for t, n, _, z in got] == [("t", n, 0.0) for n in range(9)] and [x for _, _, x, _ in got] == [0.0, 0.75, 1.5, 2.25, 3.0, 3.75, 4.5, 5.25, 6.0]
