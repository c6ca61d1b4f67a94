"""Stations, ships, people, sales and purchases of small tables by hand."""

from __future__ import annotations

from orrery.operators import empire as E


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_station_types(spark):
    objects = spark.createDataFrame([(1, "station", "Base"), (2, "station", ""), (3, "station", None), (4, "station", ""), (5, "station", ""), (6, "station", ""), (7, "buildstorage", "Base"), (8, "station", "")], "id long, class string, basename string")
    modules = [(1, "buildmodule_ships_l_a", 1), (2, "buildmodule_ships_xl_a", 1), (2, "p", 2), (3, "buildmodule_ships_m_l_", 1), (4, "buildmodule_ships_s_a", 1), (5, "buildmodule_equip_l_a", 1), (6, "q", 1), (6, "p", 2), (6, "p", 3), (6, "r", 0), (6, "r", 4), (6, None, 9), (8, "s", 1), (99, "p", 1)]
    makes = spark.createDataFrame([("p", "ore", 1), ("p", "x", 2), ("q", "ore", 1), ("r", "ice", 1), ("s", "", 1), ("s", "gas", 2), ("t", None, 1)], "macro string, ware string, ord long")
    wares = spark.createDataFrame([("ore", "Ore"), ("gas", "")], "ware string, name string")
    got = dict(found(E.station_types(objects, spark.createDataFrame(modules, "id long, macro string, ord long"), makes, wares), "id", "type"))
    assert got == {1: "Base", 2: "Shipyard", 3: "Shipyard", 4: "Wharf", 5: "Equipment Dock", 6: "Ore Factory", 7: "Build plot", 8: "gas Factory"}
    assert dict(found(E.station_types(objects, spark.createDataFrame([], "id long, macro string, ord long"), makes, wares), "id", "type"))[6] == "Station"


def test_equal_products_go_to_the_first_module(spark):
    objects = spark.createDataFrame([(1, "station", None)], "id long, class string, basename string")
    modules = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "a", 3), (1, "b", 4)], "id long, macro string, ord long")
    makes = spark.createDataFrame([("a", "ore", 1), ("b", "ice", 1)], "macro string, ware string, ord long")
    assert found(E.station_types(objects, modules, makes, spark.createDataFrame([], "ware string, name string")), "id", "type") == [(1, "ice Factory")]


def test_ships_stations_and_roles(spark):
    owned = spark.createDataFrame([(1, "ship_s", "A", "", "m"), (2, "ship_l", "B", "Two", "x"), (3, "ship_m", "C", None, "y"), (4, "station", "D", "Dock", "z"), (5, "station", "E", "Home", "z")], "id long, class string, code string, name string, macro string")
    models = spark.createDataFrame([("m", "Old", 3, 1), ("m", "Model", 9, 2)], "macro string, model string, crew long, ord long")
    people = spark.createDataFrame([(1, "service", 2), (1, "marine", 3), (1, "guest", 50), (4, "service", 9)], "object long, role string, count long")
    posts = spark.createDataFrame([(1, "aipilot", 10), (1, "aipilot", 11), (2, "engineer", 12), (4, "manager", 10), (4, "engineer", 13), (5, "shiptrader", 12), (5, "other", 14)], "object long, post string, person long")
    persons = spark.createDataFrame([(10, "P", 7, "old"), (12, "Q", 1, "old"), (13, "R", 1, None), (14, "S", 1, "old")], "id long, name string, piloting long, role string")
    ships = E.ships(owned, models, people, posts, persons)
    assert found(ships, "id", "name", "size", "model", "crew", "crew_most", "aipilot", "engineer", "pilot_name", "pilot_skill") == [(1, "Model", "S", "Model", 5, 9, 10, None, "P", 7), (2, "Two", "L", None, 0, None, None, 12, None, None), (3, "y", "M", None, 0, None, None, None, None, None)]
    rollups = spark.createDataFrame([(4, 40, "Sector")], "id long, entity_id long, sector_name string")
    stations = E.stations(owned, posts, rollups)
    assert found(stations, "id", "manager_id", "engineer_id", "shiptrader_id", "entity_id") == [(4, 10, 13, None, 40), (5, None, None, 12, None)]
    assert found(E.roles(persons, ships, stations), "id", "role") == [(10, "manager (station)"), (12, "shiptrader (station)"), (13, "engineer (station)"), (14, "old")]


def test_money_and_time(spark):
    columns = "t double, money double, amount double, ware string, seller_faction string, seller_name string, seller_code string, buyer_faction string, buyer_name string, buyer_code string"
    rows = [(1.0, 5.0, 1.0, "ore", "PLA", "s", "S", None, "b", "B"), (2.0, 6.0, 1.0, "ore", None, "s", "S", "PLA", "b", "B"), (3.0, 7.0, 1.0, "ore", "PLA", "s", "S", "PLA", "b", "B"), (4.0, 8.0, 1.0, "ore", None, "s", "S", None, "b", "B")]
    trades = spark.createDataFrame(rows, columns)
    assert found(E.sales(trades, trades.filter("t = 4")), "t", "money") == [(1.0, 5.0), (4.0, 8.0)]
    assert found(E.buys(trades), "t", "money") == [(2.0, -6.0)]
    assert found(E.clock(trades, 99.0), "now", "logged_hours") == [(4.0, 3 / 3600)] and found(E.clock(trades.limit(0), 99.0), "now", "logged_hours") == [(99.0, 0.0)]


def test_masses(spark):
    assert found(E.masses(spark.createDataFrame([(1, 2), (1, 6), (2, None)], "id long, index long")), "id", "modules", "hull") == [(1, 6, 1_500_000.0), (2, None, None)]
