"""Engines, bodies and shields of small game files, and what modifications do to them, by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.operators import equipment as E
from orrery.sources import game_files as K
from orrery.sources import patches as P
from orrery.sources import snapshot_xml as X

ENGINES = """<macros><macro name="Engine_arg_S_travel_01_mk3_macro" class="engine"><properties><thrust forward="10"/><travel thrust="4" charge="2"/></properties></macro><macro name="engine_arg_m_01_mk12_macro" class="engine"><properties><thrust reverse="5"/></properties></macro><macro name="s_engine_mk2" class="engine"><properties><thrust forward="1"/></properties></macro><macro name="engine_fx" class="engine"><properties/></macro><macro name="engine_arg_s_x" class="effect"><properties><thrust forward="1"/></properties></macro></macros>"""
THRUSTERS = """<macros><macro name="thruster_gen_s_a" class="engine"><properties><thrust strafe="1" roll="2"/></properties></macro><macro name="thruster_gen_s_b" class="engine"><properties><thrust strafe="9"/></properties></macro><macro name="thruster_gen" class="engine"><properties><thrust strafe="9"/></properties></macro></macros>"""
BODIES = """<macros><macro name="Ship_A" class="ship_xl"><properties><identification name="Big"/><purpose primary="trade"/><physics mass="7"><inertia pitch="2"/><drag forward="3" yaw="4"/></physics></properties></macro><macro name="ship_b" class="ship_s"><properties><physics mass="7"><inertia pitch="2"/></physics></properties></macro><macro name="ship_c" class="ship_s"><properties><physics><drag/></physics></properties></macro><macro name="rock" class="asteroid"><properties><physics><drag forward="3"/></physics></properties></macro></macros>"""
SHIELDS = """<macros><macro name="shield_arg_m_01" class="shieldgenerator"><properties><recharge max="100" rate="5" delay="2"/></properties></macro><macro name="Shield_x" class="shieldgenerator"><properties><recharge max="7"/></properties></macro><macro name="shield_arg_m_02" class="shieldgenerator"><properties/></macro></macros>"""


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cut")))
    d = tmp_path_factory.mktemp("equipment")
    for name, text in (("engines", ENGINES), ("engines_video", ENGINES.replace("arg", "tel")), ("thrusters", THRUSTERS), ("bodies", BODIES), ("shields", SHIELDS)):
        (d / f"{name}.xml").write_text(text)
    elems = X.elements(spark, str(d)).withColumns({"doc": F.regexp_extract("file", r"/(\w+)\.xml$", 1), "turn": F.lit(0)})
    return P.stepped(elems).withColumn("place", F.col("line")).cache()


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_engines(nodes):
    got = found(K.engines(nodes.filter("doc LIKE 'engines%'")), "macro", "size", "type", "mk", "forward", "reverse", "travel_thrust", "boost_thrust")
    assert got == [("engine_arg_m_01_mk12_macro", "m", None, 1, 0.0, 5.0, 0.0, 0.0), ("engine_arg_s_travel_01_mk3_macro", "s", "travel", 3, 10.0, 0.0, 4.0, 0.0), ("s_engine_mk2", None, None, 1, 1.0, 0.0, 0.0, 0.0)]


def test_thrusters(nodes):
    assert found(K.thrusters(nodes.filter("doc = 'thrusters'")), "size", "strafe", "pitch", "yaw", "roll") == [("s", 1.0, 0.0, 0.0, 2.0)]


def test_bodies(nodes):
    got = found(K.bodies(nodes.filter("doc = 'bodies'")), "macro", "name", "size", "purpose", "mass", "inertia_pitch", "inertia_roll", "drag_forward", "drag_yaw", "drag_roll")
    assert got == [("ship_a", "Big", "xl", "trade", 7.0, 2.0, 1.0, 3.0, 4.0, 1.0), ("ship_c", "ship_c", "s", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]


def test_shields(nodes):
    assert found(K.shields(nodes.filter("doc = 'shields'")), "macro", "size", "capacity", "rate", "delay") == [("shield_arg_m_01", "m", 100.0, 5.0, 2.0), ("shield_x", None, 7.0, 0.0, 0.0)]


MODS = "ware string, stat string, min double, max double, forced boolean, bonuses array<struct<stat:string,min:double,max:double,weight:double>>"


def test_what_is_forced_counts(spark):
    rows = [("a", "forwardthrust", 1.0, 2.0, True, [("forwardthrust", 1.0, 3.0, 1.0), ("travelchargetime", 0.5, 0.8, 1.0)]), ("b", "forwardthrust", 1.0, 2.0, False, [("boostthrust", 1.0, 3.0, 1.0)]), ("c", "strafeacc", 1.0, 1.5, True, [])]
    mods = spark.createDataFrame(rows, MODS)
    key = ("ware", "stat", "value")
    assert found(E.realised(mods, "engine"), *key) == [("a", "forwardthrust", 6.0), ("a", "travelchargetime", 0.5), ("b", "forwardthrust", 2.0), ("c", "strafeacc", 1.5)]
    assert found(E.realised(mods, "engine", "min"), *key)[0] == ("a", "forwardthrust", 1.0) and found(E.realised(mods, "engine", "max"), *key)[1] == ("a", "travelchargetime", 0.8)
    assert found(E.realised(mods, "weapon"), *key)[0] == ("a", "forwardthrust", 3.0)  # the last of a weapon's


def test_hulls(spark):
    rows = [("a", "radarcloak", -0.5, -0.2, True, [("radarcloak", -0.3, 0.0, 1.0), ("mass", 0.5, 0.9, 1.0), ("missilecapacity", 4.0, 8.0, 1.0), ("missilecapacity", 1.0, 1.0, 1.0)]), ("b", "drag", 0.0, 1.0, False, [])]
    got = found(E.compared(E.realised(spark.createDataFrame(rows, MODS), "ship"), ["radarcloak", "mass", "missilecapacity", "drag"]), "ware", "radarcloak", "mass", "missilecapacity", "drag")
    assert got == [("a", 0.8, 2.0, 9.0, 1.0), ("b", 0.0, 1.0, 0.0, 1e9)]


def test_handling_and_recovery(spark):
    names = "forward reverse boost_thrust boost_duration boost_acceleration travel_thrust travel_charge travel_attack strafe pitch yaw roll mass inertia_pitch inertia_yaw drag_forward drag_reverse drag_horizontal drag_pitch drag_yaw drag_roll".split()
    values = [100.0, 20.0, 4.0, 3.0, 0.0, 8.0, 2.0, 5.0, 30.0, 4.0, 8.0, 9.0, 0.0, 2.0, 4.0, 10.0, 5.0, 0.0, 1.0, 2.0, 3.0]
    base = spark.createDataFrame([("bare", *values, None), ("mod", *values, {"forwardthrust": 2.0, "rotationthrust": 3.0, "travelchargetime": 0.5, "strafeacc": 0.0, "boostacc": 5.0})], "name string, " + ", ".join(f"{n} double" for n in names) + ", effects map<string,double>")
    got = {r["name"]: r for r in E.handling(base, ["name"]).collect()}
    bare, mod = got["bare"], got["mod"]
    assert (bare["forward_speed"], bare["forward_accel"], bare["reverse_speed"], bare["strafe_speed"], bare["strafe_accel"], bare["boost_speed"], bare["boost_accel"], bare["travel_speed"], bare["turn_rate"], bare["turn_accel"], bare["roll_rate"]) == (10.0, 100.0, 4.0, None, 30.0, 40.0, 100.0, 80.0, 4.0, 2.0, 3.0)
    assert (mod["forward_speed"], mod["travel_charge"], mod["travel_attack"], mod["turn_rate"], mod["roll_rate"], mod["strafe_accel"], mod["boost_accel"]) == (20.0, 1.0, 5.0, 12.0, 9.0, 30.0, 200.0)
    shields = spark.createDataFrame([("a", 100.0, 5.0, 2.0, {"capacity": 2.0, "rechargedelay": 0.5}), ("b", 100.0, 0.0, 2.0, None)], "ware string, capacity double, rate double, delay double, effects map<string,double>")
    assert found(E.recovery(shields, ["ware"]), "ware", "capacity", "rate", "delay", "refill") == [("a", 200.0, 5.0, 1.0, 41.0), ("b", 100.0, 0.0, 2.0, 2.0)]


def test_usual_engine(spark):
    rows = [("e1", "s", "travel", 1), ("e2", "s", "allround", 2), ("e4", "s", "allround", 1), ("e3", "s", "allround", 1), ("m1", "m", "combat", 3), ("m2", "m", "allround", 3), ("l2", "l", "travel", 1), ("l1", "l", None, 2), ("x", None, "allround", 1)]
    got = found(E.usual_engine(spark.createDataFrame(rows, "macro string, size string, type string, mk int")), "size", "macro")
    assert got == [("l", "l1"), ("m", "m2"), ("s", "e3")]
