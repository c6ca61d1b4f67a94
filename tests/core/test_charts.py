"""Hourly money, earnings and presets of small tables by hand."""

from __future__ import annotations

import pytest

from orrery.operators import charts as Q

SALES = "t double, ware string, money double, seller_name string, seller_code string, buyer_faction string"
BUYS = "t double, ware string, money double, buyer_name string, buyer_code string"


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_groups(spark):
    sales = [(0.0, "Ship construction", 5.0, "Yard", "Y", None), (1.0, "ore", 2.0, "Dock", "D", "ARG"), (2.0, "ore", 3.0, "Ship", None, None), (3.0, "fix", 9.0, "Dock", "D", "ARG"), (4.0, None, 1.0, None, "S", "TEL"), (5.0, "ore", 0.0, "Dock", "D", "ARG")]
    buys = [(0.0, "ore", -4.0, "Ship", "S"), (1.0, "ore", 4.0, "Ship", "S")]
    stations = spark.createDataFrame([("D",), ("D",), (None,)], "code string")
    got = found(Q.grouped(spark.createDataFrame(sales, SALES), spark.createDataFrame(buys, BUYS), stations, ["fix"]), "chart", "group", "t", "money")
    assert got == sorted(
        [("construction", "NIL", 0.0, 5.0), ("faction", "ARG", 1.0, 2.0), ("faction", "TEL", 4.0, 1.0), ("seller", "Dock", 1.0, 2.0), ("seller", "Ship (?)", 2.0, 3.0), ("seller", "? (S)", 4.0, 1.0), ("buyer", "Ship (S)", 0.0, 4.0)], key=repr
    )


def test_hours_are_filled_within_a_chart(spark):
    rows = spark.createDataFrame([("a", "x", 3600.0 * 5, 1.0), ("a", "x", 3600.0 * 5 - 1, 2.0), ("a", "y", 3600.0 * 2, 4.0), ("b", "z", 0.0, 8.0)], "chart string, group string, t double, money double")
    got = found(Q.series(rows, 3600.0 * 5), "chart", "group", "hour", "money", "running")
    assert got == sorted([("a", "x", 0, 3.0, 3.0), ("a", "x", -3, 0.0, 0.0), ("a", "y", -3, 4.0, 4.0), ("a", "y", 0, 0.0, 4.0), ("b", "z", -5, 8.0, 8.0)], key=repr)
    assert Q.series(rows.limit(0), 0.0).collect() == []


@pytest.mark.parametrize("n, width", [(1, 1), (2, 1), (5, 2), (6, 3), (30, 12)])
def test_means_of_few_hours_take_half_of_them(spark, n, width):
    rows = spark.createDataFrame([("a", "x", -3600.0 * k, float(k * k)) for k in range(n)], "chart string, group string, t double, money double")
    money = [float(k * k) for k in reversed(range(n))]  # by hour
    want = {i - n + 1: sum(money[i - width // 2 : i - width // 2 + width]) / width for i in range(n) if i - width // 2 >= 0 and i - width // 2 + width <= n}
    got = {r["hour"]: r["mean"] for r in Q.means(rows, 0.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-9 for h in want)


def test_transfers(spark):
    rows = spark.createDataFrame([(0.0, None, "C", 1.0), (0.0, "N", "C", None), (0.0, None, None, 2.0)], "t double, station_name string, station_code string, money double")
    assert found(Q.transfers(rows, 0.0), "chart", "group", "hour", "running") == [("transfers", "?", 0, 2.0), ("transfers", "C", 0, 1.0), ("transfers", "N", 0, 0.0)]


def test_earnings(spark):
    outside = spark.createDataFrame([("a", 10.0, 4.0), ("a", 5.0, 2.0), ("b", 7.0, 0.0)], "who string, money double, amount double")
    inside = spark.createDataFrame([("a", 3.0, 1.0), ("c", 9.0, 3.0)], "who string, money double, amount double")
    got = found(Q.earnings_variants(outside, inside, ["who"], 2.0), "variant", "who", "earnings", "trades", "per_trade", "per_item", "items_per_trade", "per_hour", "trades_per_hour")
    assert got == sorted([("external", "a", 15.0, 2, 8.0, 2.0, 3.0, 8.0, 1.0), ("external", "b", 7.0, 1, 7.0, None, 0.0, 4.0, 0.5), ("all", "a", 18.0, 3, 6.0, 3.0, 2.0, 9.0, 1.5), ("all", "b", 7.0, 1, 7.0, None, 0.0, 4.0, 0.5), ("all", "c", 9.0, 1, 9.0, 3.0, 3.0, 4.0, 0.5)], key=repr)


def test_presets(spark):
    ships = spark.createDataFrame([(1, "One", "A", "Hull_A"), (2, None, "B", "hull_a"), (3, "", None, "hull_b"), (4, "Four", "D", "hull_c"), (5, "Five", "E", "none"), (6, "Six", "F", "hull_b")], "ship long, name string, code string, macro string")
    models = spark.createDataFrame([("hull_a", "Alpha", "L", 100.0, "container solid", 4.0), ("hull_b", "Beta", "M", 50.0, "container", 0.0), ("hull_c", "Gamma", "M", 50.0, "liquid", 1.0)], "macro string, model string, size string, hold double, tags string, drag double")
    engines = spark.createDataFrame([("e", 10.0, 8.0), ("f", None, 8.0)], "macro string, forward double, travel_thrust double")
    mounts = spark.createDataFrame([(1, "e", 2), (1, "f", 9), (2, "e", 2), (3, "e", 2), (6, "x", 1)], "ship long, macro string, n long")
    assert found(Q.presets(ships, mounts, models, engines), "label", "model", "hold", "speed", "n") == [("Alpha ×2", "Alpha", 100.0, 40, 2), ("Beta ×2", "Beta", 50.0, None, 2)]
    assert found(Q.presets(ships.filter("ship IN (1, 3)"), mounts, models, engines), "label", "n") == [("Beta — Beta", 1), ("One (A) — Alpha", 1)]
