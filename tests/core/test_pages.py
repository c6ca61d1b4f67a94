"""Rules of an empire's pages on small tables that are worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.operators import accounts as A
from orrery.operators import books as B
from orrery.operators import chronicle as H
from orrery.operators import mining as M
from orrery.operators import trips as T

WARES = "station long, ware string, class string, volume double, used double, observed double, stock double, limit double"
POOLS = "station long, class string, size string, miners long, hold double, rate double, more long"


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_split_by_volume_or_evenly(spark):
    wares = spark.createDataFrame([(1, "ore", "solid", 10.0, 30.0, 5.0, 0.0, None), (1, "ice", "solid", 5.0, 20.0, None, 0.0, None), (2, "ore", "solid", 10.0, None, 4.0, 0.0, None), (2, "gem", "solid", None, 0.0, 1.0, 0.0, None), (3, "gas", "liquid", 2.0, 6.0, 0.0, 0.0, None)], WARES)
    pools = spark.createDataFrame([(1, "solid", "M", 1, 400.0, 2.0, 0), (1, "solid", "L", 1, 100.0, 1.0, 0), (2, "solid", "M", 1, 100.0, 1.0, 0)], POOLS)
    got = {(r["station"], r["ware"]): r for r in M.split(wares, pools).collect()}
    assert got[1, "ore"]["share"] == 0.75 and got[1, "ore"]["theoretical"] == 900 * 0.75 / 10 and got[1, "ore"]["balance"] == -25
    assert got[1, "ice"]["share"] == 0.25 and got[1, "ice"]["class_used"] == 400 and got[1, "ice"]["class_observed"] == 50
    assert got[2, "ore"]["share"] == 0.5 and got[2, "gem"]["theoretical"] == 50.0  # an unknown volume is one
    assert got[3, "gas"]["theoretical"] == 0.0 and got[3, "gas"]["share"] == 1.0


def test_cards(spark):
    wares = spark.createDataFrame(
        [
            (1, "ore", "solid", 1.0, 30.0, 5.0, 0.0, 100.0), (1, "ice", "solid", 1.0, 20.0, 0.0, 99.0, 100.0),
            (2, "ore", "solid", 1.0, 30.0, 5.0, 96.0, 100.0), (2, "gem", "solid", 1.0, 0.0, 0.0, 0.0, 100.0),
            (3, "ore", "solid", 1.0, 30.0, 30.0, 0.0, None), (4, "ore", "solid", 1.0, 30.0, 1.0, 0.0, None), (4, "gas", "liquid", 1.0, 0.0, 3.0, 0.0, None),
        ],
        WARES,
    )
    pools = spark.createDataFrame([(1, "solid", "L", 2, 100.0, 1.0, 3), (1, "solid", "S", 0, 10.0, 3.0, 7), (1, "solid", "M", 0, 10.0, 1.0, 0), (2, "solid", "S", 1, 10.0, 1.0, 25), (3, "solid", "S", 0, 10.0, 1.0, 0)], POOLS)
    got = {(r["station"], r["class"]): r for r in M.cards(M.split(wares, pools), pools).collect()}
    one = got[1, "solid"]
    assert (one["state"], one["options"], one["least"], one["hauls"], one["blocked"], one["station_need"]) == ("short", ["+7 S", "+3 L"], 3, ["S 0 30", "L 2 100"], ["ice"], 3)
    assert one["percent"] == 10.0
    full = got[2, "solid"]  # what is used has no room left, what isn't used doesn't count
    assert (full["state"], full["options"], full["least"], full["blocked"], full["station_need"]) == ("full", [], None, ["ore"], 0)
    assert got[3, "solid"]["state"] == "covered" and got[3, "solid"]["hauls"] == []
    assert got[4, "solid"]["state"] == "short" and got[4, "solid"]["options"] == []  # no miners known
    assert got[4, "liquid"]["state"] == "covered" and got[4, "liquid"]["percent"] is None
    assert not M.cards(M.split(wares.limit(0), pools), pools).collect()


TRADES = "t double, ware string, amount long, money double, " + ", ".join(f"{s}_{c} string" for s in ("seller", "buyer") for c in ("faction", "name", "code", "proxy_name", "proxy_code"))


def test_trade_records(spark):
    rows = [
        (1.0, "ore", 5, 99.9, "PLA", "Dock", "D1", "Miner", "M1", "ARG", "Mart", "A1", None, None),
        (2.0, "ore", 5, 10.0, "PLA", "Dock", "D1", None, None, None, None, "A1", None, None),
        (3.0, "ore", None, None, "TEL", "Shop", None, None, None, "PLA", "Ship", "B1", None, None),
        (4.0, "ore", 5, 10.0, "PLA", "Dock", "D1", None, None, "PLA", "Ship", "B1", None, None),
        (5.0, "ore", 5, 10.0, "TEL", "Shop", "T1", None, None, "ARG", "Mart", "A1", None, None),
        (6.0, "ore", 5, 10.0, "PLA", "", "D1", None, None, "ARG", "Mart", "A1", None, None),
        (7.0, "ore", 5, 10.0, "PLA", None, "D1", "Miner", "M9", "ARG", "Mart", "A1", None, None),
    ]
    leaders = spark.createDataFrame([("M1", "Osaka (O)"), ("M1", "Zen (Z)"), ("B1", "Osaka (O)"), (None, "x"), ("D1", None)], "code string, leader string")
    got = found(H.trade_records(spark.createDataFrame(rows, TRADES), leaders), "t", "amount", "money", "partner", "object", "via")
    assert got == [
        (1.0, 5, 99, "ARG: Mart (A1)", "Dock (D1)", "Osaka (O) - Miner (M1)"),
        (1.0, 5, 99, "ARG: Mart (A1)", "Osaka (O) - Miner (M1)", ""),
        (2.0, 5, 10, "?: ?", "Dock (D1)", ""),
        (3.0, 0, 0, "TEL: Shop", "Osaka (O) - Ship (B1)", ""),
        (7.0, 5, 10, "ARG: Mart (A1)", "Miner (M9)", ""),
    ]


@pytest.mark.parametrize("killer, faction", [("XEN Raider F (GZM-478)", "XEN"), ("XEN", "XEN"), (" XEN-1", "XEN"), ("XENON", "?"), ("XEN_1", "?"), ("XEN1", "?"), ("XENé", "?"), ("xen a", "?"), ("QQQ a", "?"), ("", "?"), (None, "?")])
def test_killers(spark, killer, faction):
    destroyed = spark.createDataFrame([(0.0, None, None, killer)], "t double, object string, sector string, killer string")
    shorts = spark.createDataFrame([("XEN",), ("XEN",), (None,), ("Xe",), ("xen",)], "short string")
    assert found(H.losses(destroyed, shorts, 5400.0), "hours_ago", "object", "sector", "killer", "faction") == [(1.5, "?", "?", killer or "", faction)]


def test_bounties_count_once_in_all(spark):
    rows = [(1, "A", "a", "ship", "ARG", 100.0, 0.0), (1, "B", None, "", "ARG", 100.0, 0.0), (1, "A", "a", "ship", "TEL", 100.0, 0.0), (2, "A", "a", "ship", "ARG", None, 3600.0)]
    rewards = spark.createDataFrame(rows, "reward long, ship string, code string, kind string, faction string, bounty double, t double")
    assert found(H.bounties(rewards, 7200.0), "who", "kind", "rewards", "bounty", "factions", "hours_ago") == [("A (a)", "ship", 2, 200, 2, 1.0), ("B (?)", "?", 1, 100, 1, 2.0)]
    assert found(H.bounty_total(rewards), "rewards", "bounty") == [(2, 100.0)]
    assert found(H.bounty_total(rewards.limit(0)), "rewards", "bounty") == [(0, 0.0)]
    claims = spark.createDataFrame([(0.0, "A", "a", "s", "C", None), (3600.0, "B", "b", "s", None, "c")], "t double, finder string, finder_code string, sector string, claimed string, claimed_code string")
    assert [tuple(r) for r in H.claims(claims, 7200.0).collect()] == [(1.0, "B (b)", "s", None), (2.0, "A (a)", "s", "C")]


def test_payback_and_running_net(spark):
    values = A.station_values(spark.createDataFrame([(1, "m"), (1, "m"), (1, "x"), (2, "x")], "station long, macro string"), spark.createDataFrame([("M", 10.0), ("m", 7.0), ("", 99.0), ("x", None)], "component string, price double"))
    assert found(values, "station", "value") == [(1, 20.0), (2, 0.0)]
    result = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, 1.0), (1, -1.0)], "station long, net_h double")
    assert found(A.with_payback(result, values), "station", "value", "payback") == [(1, 20.0, 5.0), (1, 20.0, None), (2, 0.0, None), (3, 0.0, None)]
    ledger = spark.createDataFrame([(1, 0.0, 5.0, 0.0), (1, 10.0, 0.0, 2.0), (1, 10.0, 1.0, 0.0), (1, 25.0, 3.0, 0.0), (2, 5.0, 1.0, 0.0)], "station long, t double, revenue double, cost double")
    assert found(A.cumulative(ledger, 3600.0, 10.0), "station", "t", "total") == [(1, 0.0, 5.0), (1, 10.0, 4.0), (1, 25.0, 7.0), (2, 5.0, 1.0)]


def test_resources(spark):
    rows = [("s", "ore", 5.4, 10.0, 30.0, 0.0, "slow"), ("s", "ore", 0.0, 8.0, 30.0, 50.0, None), ("s", "ore", 0.0, 9.0, 0.0, 190.0, None), ("s", "gas", 0.0, None, 5.0, 0.0, None), ("z", "gas", 0.0, 7.0, -1.0, 0.0, None)]
    areas = A.mineable(spark.createDataFrame(rows, "sector string, ware string, left double, capacity double, respawn double, start double, speed string"), 100.0)
    assert found(A.sector_resources(areas, ["ore", "gas"]), "sector", "ore", "gas", "rep.ore", "rep.gas") == [("s", 13.4, 0.0, 36.0, 0.0), ("z", 0.0, 0.0, 0.0, 0.0)]
    got = {r["sector"]: {w: [tuple(x) for x in a] for w, a in r["areas"].items()} for r in A.area_lists(areas).collect()}
    assert got == {"s": {"ore": [("full", 8, 8, "", None), ("live", 10, 5, "slow", None), ("respawning", 9, 0, "", 2)], "gas": [("unknown", 0, 0, "", None)]}, "z": {"gas": [("never", 7, 0, "", None)]}}


def test_relations(spark):
    rel = spark.createDataFrame([("a", "b", 0.1, 0.0, 0.5), ("b", "a", 0.0, 0.0, -2.0), ("a", "x", 0.0, 0.0, 1.0), ("a", "a", 0.0, 0.0, 1.0)], "faction string, other string, base double, booster double, effective double")
    assert found(A.relation_matrix(rel, ["a", "b", "c"]), "faction", "a", "b", "c") == [("a", None, 0.5, 0.0), ("b", -2.0, None, 0.0), ("c", 0.0, 0.0, None)]
    off = spark.createDataFrame([("a", "b", 0.1), ("c", "a", 0.3)], "faction string, other string, discount double")
    held = spark.createDataFrame([("b", " a  c "), ("b", "a"), ("b", None), ("a", "c")], "faction string, factions string")
    assert found(A.standings(["a", "b", "c"], rel, off, held, "b"), "faction", "effective", "band", "discount", "licences") == [("a", -1.0, "War", 0.1, 2), ("c", 0.0, "Neutral", 0.0, 1)]


def test_trips(spark):
    lane = "units double, reserve_units double, volume double, spread double, plain_km double, highway_km double, quick_plain_km double, quick_highway_km double"
    lanes = spark.createDataFrame([(7.5, 100.0, 10.0, 3.0, 90.0, 9.0, 45.0, 100.0), (7.5, 100.0, None, 3.0, None, None, None, None)], lane)
    ships = [{"preset": "s", "size": "S", "hold": 55, "speed": 1000}, {"preset": "l", "size": "L", "hold": 5000, "speed": 1000}, {"preset": "none", "size": "M", "hold": 0, "speed": 0}]
    got = found(T.earnings(lanes, ships, {"S": 60, "L": 10}).filter("plain_km IS NOT NULL"), "preset", "profit", "seconds", "per_hour")
    assert got == [("l", 21.0, pytest.approx(120.0), pytest.approx(630.0)), ("none", None, None, None), ("s", 15.0, pytest.approx(120.0), pytest.approx(450.0))]
    assert found(T.earnings(lanes, ships[:1], {}, reserve=True), "profit", "seconds") == [(15.0, pytest.approx(60.0)), (None, None)]
    row = spark.range(1).select(T.traders(F.lit(100.0), F.lit(10.0), F.lit(3600.0)).alias("a"), T.traders(F.lit(0.0), F.lit(10.0), F.lit(3600.0)).alias("b"), T.traders(F.lit(1.0), F.lit(10.0), F.lit(None)).alias("c"), T.trend(F.lit(1.2), F.lit(1.0)).alias("d"), T.trend(F.lit(0.8), F.lit(1.0)).alias("e"), T.trend(F.lit(1.1), F.lit(1.0)).alias("f"), T.change(F.lit(3.0), F.lit(2.0)).alias("g"), T.change(F.lit(2.0), F.lit(2.0)).alias("h"), T.change(F.lit(2.0), F.lit(0.0)).alias("i"))
    assert tuple(row.first()) == (10, None, None, "up", "down", "", 50.0, None, None)


def test_book_keeps_the_best_that_offer_enough(spark):
    offers = spark.createDataFrame([("w", "buy", k, float(k), 100) for k in range(12)] + [("w", "sell", k, float(k), 100 if k else 1) for k in range(3)], "ware string, side string, station long, price double, amount long")
    got = found(T.book(offers, 0.5), "side", "station", "rank")
    assert got == sorted([("buy", 11 - k, k + 1) for k in range(10)] + [("sell", 1, 1), ("sell", 2, 2)], key=repr)


def test_score_of_no_weights(spark):
    df = spark.createDataFrame([(0.5, 1.0)], "a double, b double")
    assert tuple(df.select(T.score({"a": 2}, {"b": 2}), T.score({"a": 0}, {})).first()) == (-25.0, 0.0)


def test_shady_stations_without_workers(spark):
    book = spark.createDataFrame([(1, "shady", "fixed"), (1, "shady", "fixed"), (2, "shady", "fixed"), (3, "shady", "continuum"), (4, "main", None)], "station long, book string, tier string")
    hands = spark.createDataFrame([(1, 0), (2, 5), (2, 1)], "station long, amount long")
    assert found(B.shady_census(book, hands), "tier", "stations", "offers", "idle") == [("continuum", 1, 1, 1.0), ("fixed", 2, 3, 0.5)]
