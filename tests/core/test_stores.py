"""Upgrades of stores, plans of backfill, former logs, and sessions across restarts of a stream."""

import gzip
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orrery.streaming import backfill as B
from orrery.streaming import schemas as S
from orrery.streaming import sessions as N
from orrery.streaming.merge import EVENTS, Store

OLD = "time double, owner_id string, ware string, level double, raw_attrs string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture
def old(spark, tmp_path):
    store = S.Versioned(spark, str(tmp_path / "store"))
    stock = spark.createDataFrame([(1.0, "a", "ore", 5.0, None), (2.0, "a", "", 7.0, '{"type":"sale","v":"100","v2":"250","partner":"b","tradeentry":"3"}'), (3.0, "b", "", 1.0, '{"type":"x","v":"bad"}'), (4.0, "b", "", 9.0, None)], OLD)
    log = spark.createDataFrame([(5.0, "upkeep", "i"), (6.0, None, None), (7.0, "upkeep", None)], "time double, category string, interact string")
    store.write({"stock_event": stock, "trade_tx": spark.createDataFrame([(8.0, 3.0)], "time double, amount double"), "log_entry": log, "component": spark.range(3).toDF("id"), "zombie": spark.range(3).toDF("id"), "removed_object": spark.range(1).toDF("id")}, 1)
    return store


def test_the_chain_is_complete():
    assert sorted(S.CHAIN) == list(range(2, S.NEWEST + 1))


def test_a_store_of_version_one_is_upgraded(old):
    state = old.upgrade(known=["component"])
    t = old.tables()
    assert state.version == S.NEWEST and set(t) == {"stock_event", "trade_tx", "money_event", "log_entry", "coverage", "removed_object"}
    assert rows(t["stock_event"], "time", "ware", "epoch", "owner_entity") == [(1.0, "ore", 0, None), (4.0, "", 0, None)]
    assert rows(t["money_event"], "time", "owner_id", "partner_id", "kind", "tradeentry", "value_cr") == [(2.0, "a", "b", "sale", 3, 2.5), (3.0, "b", None, "x", None, None)]
    assert rows(t["trade_tx"], "time", "amount", "kind", "buyer_cmdr_id", "epoch") == [(8.0, 3.0, "trade", None, 0)]
    assert rows(t["coverage"], "stream", "epoch", "t_min", "t_max") == [("log:", 0, 6.0, 6.0), ("log:upkeep", 0, 5.0, 7.0), ("money_event", 0, 2.0, 3.0), ("stock_event", 0, 1.0, 4.0), ("trade_tx", 0, 8.0, 8.0)]
    assert "interaction" in t["log_entry"].columns and t["removed_object"].columns == ["id", "first_save_id"]
    assert old.upgrade() == state  # twice in a row alike


def test_later_versions_keep_what_they_have(spark, tmp_path):
    store = S.Versioned(spark, str(tmp_path / "store"))
    money = spark.createDataFrame([(1.0, "a", 2)], "time double, owner_id string, epoch long")
    cover = spark.createDataFrame([("money_event", 2, 0.5, 0.9, 0.7), ("other", 0, 1.0, 2.0, 1.5)], S.COVERAGE)
    store.write({"money_event": money, "coverage": cover}, 5)
    store.upgrade()
    assert rows(store.tables()["coverage"], "stream", "epoch", "t_min", "t_max", "window_start") == [("money_event", 2, 0.5, 1.0, 0.7), ("other", 0, 1.0, 2.0, 1.5)]
    store.write({}, S.NEWEST + 1)
    with pytest.raises(ValueError):
        store.upgrade()
    assert S.Versioned(spark, str(tmp_path / "none")).upgrade().version is None


def test_an_upgrade_that_breaks_off_is_done_again(old):
    def stop(t):
        return {"trade_tx": t["trade_tx"].withColumn("x", F.raise_error(F.lit("stop")))}

    broken = S.Versioned(old.spark, old.root, S.CHAIN | {S.NEWEST: [*S.CHAIN[S.NEWEST], stop]})
    before = old.state()
    with pytest.raises(Exception):
        broken.upgrade()
    assert old.state() == before and old.tables()["stock_event"].count() == 4
    old.upgrade()
    assert old.state().version == S.NEWEST and old.tables()["stock_event"].count() == 2


FOUND, KNOWN = "file string, guid string, game_time double, save_date string", "guid string, game_time double, save_date string, covered boolean"


def planned(spark, found, known):
    return [(r.guid, r.turn, r.file, r.action) for r in B.plan(spark.createDataFrame(found, FOUND), spark.createDataFrame(known, KNOWN)).orderBy("guid", F.col("turn").asc_nulls_last(), "file").collect()]


def test_backfill_plans(spark):
    old, new = ("old", "G", 4.0, "1"), ("new", "G", 5.0, "2")
    assert planned(spark, [new, old], []) == [("G", 1, "old", "import"), ("G", 2, "new", "import")]  # their order in the input doesn't matter
    head = ("G", 5.0, "2", True)
    assert planned(spark, [old, new], [head]) == [("G", 1, "old", "import"), ("G", 2, "new", "restore")]
    assert planned(spark, [old, new], [("G", 4.0, "1", True), head]) == [("G", None, "new", "skip"), ("G", None, "old", "skip")]
    assert planned(spark, [old], [head]) == [("G", None, "old", "refuse")]  # would leave an older world behind
    assert planned(spark, [old], [("G", 4.0, "1", False), ("H", 9.0, None, True)]) == [("G", 1, "old", "import")]
    assert planned(spark, [new, ("copy", "G", 5.0, "2"), ("s/Temp.xml", "G", 6.0, "3"), ("x", None, None, None)], []) == [(None, None, "x", "unreadable"), ("G", 1, "copy", "import"), ("G", None, "new", "skip"), ("G", None, "s/Temp.xml", "busy")]
    assert planned(spark, [], []) == []


def test_replay_merges_in_order_and_keeps_what_is_newer(spark, tmp_path):
    window = lambda a, b: spark.createDataFrame([(float(t), t, "s", "i", t * 1.0) for t in range(a, b)], EVENTS)
    files = {"late": ("G", 30.0, window(10, 31)), "early": ("G", 20.0, window(5, 21)), "other": ("H", 9.0, window(0, 10))}
    stores = {g: Store(spark, str(tmp_path / g)) for g in "GH"}
    found = spark.createDataFrame([(f, g, t, None) for f, (g, t, _) in files.items()], FOUND)
    out = B.replay(B.plan(found, spark.createDataFrame([], KNOWN)), stores.get, lambda f: files[f][2])
    assert out == [("early", True), ("late", True), ("other", True)]
    events = stores["G"].read("events", f"{EVENTS}, epoch long")
    assert [r.t for r in events.orderBy("t").collect()] == [float(t) for t in range(5, 31)] and events.select("epoch").distinct().count() == 1
    again = B.plan(spark.createDataFrame([("older", "G", 10.0, None), ("late", "G", 30.0, None)], FOUND), spark.createDataFrame([("G", 20.0, None, True), ("G", 30.0, None, True)], KNOWN))
    assert B.replay(again, stores.get, lambda f: window(0, 11) if f == "older" else files[f][2]) == [("older", False), ("late", True)]
    assert stores["G"].read("events", f"{EVENTS}, epoch long").count() == 26


def test_former_logs(spark, tmp_path):
    stored = spark.createDataFrame([(10.0, "a"), (12.0, "a"), (5.0, None)], "time double, category string")
    former = spark.createDataFrame([(9.0, "a"), (10.0, "a"), (11.0, "a"), (4.0, None), (6.0, None), (7.0, "b"), (None, "a")], "time double, category string")
    new = B.older(stored, former, ["category"])
    assert rows(new, "time", "category") == [(4.0, None), (7.0, "b"), (9.0, "a")]
    assert B.older(stored.unionByName(new), former, ["category"]).count() == 0
    assert rows(B.older(stored, former), "time") == [(4.0,)] and B.older(stored.limit(0), former).count() == 6
    assert B.former_log(spark, str(tmp_path / "log")) is None
    (tmp_path / "log.csv").write_text("time\ttitle\n1\told\n")
    assert B.former_log(spark, str(tmp_path / "log")).first().title == "old"
    (tmp_path / "log.csv.gz").write_bytes(gzip.compress(b"time\ttitle\n2\t\n"))
    assert tuple(B.former_log(spark, str(tmp_path / "log")).first()) == ("2", None)


def test_sessions_go_on_where_a_stream_stopped(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema, at = "k long, at timestamp", lambda *m: [(1, t0 + timedelta(minutes=x)) for x in m]

    def feed(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        N.run(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), ["k"], "at", 600, 0).awaitTermination()
        return sorted((r.k, (r.first - t0).seconds // 60, (r.last - t0).seconds // 60, r.n) for r in spark.read.schema("k long, first timestamp, last timestamp, n long").parquet(str(tmp_path / "out")).collect())

    assert feed(*at(0, 5, 15), (2, t0)) == [(2, 0, 0, 1)]  # the first run is open yet
    assert feed(*at(25, 40)) == [(1, 0, 25, 4), (2, 0, 0, 1)]  # the open run went on; a gap of just ten minutes doesn't end it
    assert feed(*at(3, 90)) == [(1, 0, 25, 4), (1, 40, 40, 1), (2, 0, 0, 1)]  # what comes late is dropped
    batch = N.sessions(spark.createDataFrame([*at(0, 10, 21), (1, None)], schema), ["k"], "at", 600)
    assert sorted(r.n for r in batch.collect()) == [1, 2]
