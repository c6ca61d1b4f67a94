import random

import pytest
from pyspark.sql import functions as F

from orrery.plans.relational import checkpoints
from orrery.streaming import merge as M
from orrery.streaming import registry as R


def in_turn(components, entities):
    """The claims of all components, one after the other, over all entities each time."""
    left, out = list(entities), {}
    for c in sorted(components):
        n, _, code, kind, macro, owner, _, spawn = c
        if not code or not (kind.startswith("ship_") or kind in ("station", "buildstorage")):
            continue
        like = [e for e in left if (e[1], e[2], e[6]) == (code, kind, spawn)]
        alive, gone = [e for e in like if e[9] is None], [e for e in like if e[9] is not None]
        pick = min(alive, key=lambda e: (e[3] != macro, e[4] != owner, e[8], e[0])) if alive else max(gone, key=lambda e: (e[8], e[0]), default=None)
        if pick:
            left.remove(pick)
        out[n] = pick and pick[0]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_claims_are_those_made_in_turn(spark, seed):
    checkpoints(spark)
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice(x)
    comps = [(n * 40_000, f"[{n}]", pick("A", "B", "C", "D", None, ""), pick("ship_s", "station", "npc"), pick("m1", "m2", None), pick("p", "q", None), pick("x", "y", None), pick(1.0, 2.0, None)) for n in range(1, 90)]
    ents = []
    for n in range(1, 80):
        gone = pick(None, None, 6.0)
        ents.append((n, pick("A", "B", "C", "E"), pick("ship_s", "station"), pick("m1", "m2", None), pick("p", "q", None), "x", pick(1.0, 2.0, None), 0.0, float(pick(1, 2, 3)), gone, gone and "disappeared"))
    c, e = spark.createDataFrame(comps, R.COMPONENT), spark.createDataFrame(ents, R.ENTITY)
    want = in_turn(comps, ents)
    registry, mapping, events = R.reconcile(c, e, 9.0)
    fresh = {n: 79 + k for k, n in enumerate(sorted(n for n, x in want.items() if x is None), 1)}
    assert {r.ord: r.entity_id for r in mapping.collect()} == {n: x or fresh[n] for n, x in want.items()}
    got = {r.entity_id: r for r in registry.collect()}
    assert len(got) == registry.count() == 79 + len(fresh)
    by_ord = {x[0]: x for x in comps}
    minted = {by_ord[n][2:4] for n in fresh}
    claimed = {x: n for n, x in want.items() if x}
    for x in ents:
        r = got[x[0]]
        assert r.macro == x[3] and r.first_seen == 0.0
        if x[0] in claimed:
            assert (r.owner, r.name, r.last_seen, r.gone_time, r.gone_reason) == (by_ord[claimed[x[0]]][5], by_ord[claimed[x[0]]][6], 9.0, None, None)
        else:
            assert (r.last_seen, r.gone_time) == (x[8], x[9] or 9.0) and r.gone_reason == (x[10] or ("recycled" if x[1:3] in minted else "disappeared"))
    changes = [(x[0], kind, x[i], by_ord[claimed[x[0]]][j]) for x in ents if x[0] in claimed for kind, i, j in (("captured", 4, 5), ("renamed", 5, 6)) if x[i] != by_ord[claimed[x[0]]][j]]
    assert sorted(map(repr, changes)) == sorted(repr((r.entity_id, r.kind, r.was, r.now)) for r in events.collect())

    same, mapping, events = R.reconcile(c, e, 5.0)  # older than what is known
    assert {r.ord: r.entity_id for r in mapping.collect()} == want and same is e and events.isEmpty()


def test_registry_of_nothing(spark):
    checkpoints(spark)
    registry, mapping, events = R.reconcile(spark.createDataFrame([], R.COMPONENT), spark.createDataFrame([], R.ENTITY), 1.0)
    assert registry.isEmpty() and mapping.isEmpty() and events.isEmpty()


def batch(spark, *rows):
    return spark.createDataFrame([(t, n, "s", "ore", 1.0) for t, n in rows], M.EVENTS)


def held(store):
    return sorted((r.t, r.ord, r.epoch) for r in store.read("events", f"{M.EVENTS}, epoch long").collect())


def test_store_keeps_what_a_late_or_repeated_snapshot_would_destroy(spark, tmp_path):
    store = M.Store(spark, str(tmp_path / "s"), width=10.0)
    assert M.process(store, batch(spark, (1.0, 1), (15.0, 2), (25.0, 3), (None, 4)), 30.0)
    first = held(store)
    assert first == [(1.0, 1, 0), (15.0, 2, 0), (25.0, 3, 0)]
    assert not M.process(store, batch(spark, (1.0, 9)), 29.0) and held(store) == first
    assert M.process(store, batch(spark, (15.0, 2), (25.0, 3)), 30.0) and held(store) == first
    assert M.process(store, batch(spark, (25.0, 5), (25.0, 6), (28.0, 7)), 31.0)
    assert held(store) == [(1.0, 1, 0), (15.0, 2, 0), (25.0, 5, 0), (25.0, 6, 0), (28.0, 7, 0)]
    assert M.process(store, batch(spark, (25.0, 8), (40.0, 9)), 45.0)  # fewer rows at the boundary: the stored ones stay
    assert held(store)[2:] == [(25.0, 5, 0), (25.0, 6, 0), (40.0, 9, 0)]
    assert M.process(store, batch(spark, (50.0, 10)), 55.0) and held(store)[-1] == (50.0, 10, 1)
    assert M.process(store, batch(spark, (None, 11)), None) and M.process(store, batch(spark), 60.0)
    assert not M.process(store, batch(spark, (55.0, 12)), 59.0)
    assert [(r.epoch, r.t_min, r.t_max, r.window_start) for r in store.read("coverage", M.COVERAGE).orderBy("epoch").collect()] == [(0, 1.0, 40.0, 25.0), (1, 50.0, 50.0, 50.0)]
    before = held(store)
    store.clean()
    assert held(store) == before


def test_high_water_falls_back_to_the_newest_event(spark, tmp_path):
    store = M.Store(spark, str(tmp_path / "s"))
    assert M.process(store, batch(spark, (100.0, 1)), None)
    assert not M.process(store, batch(spark, (5.0, 2)), 99.0) and M.process(store, batch(spark, (100.0, 1)), 100.0)
    assert held(store) == [(100.0, 1, 0)]


def test_a_store_of_many_ranges_is_written_anew(spark, tmp_path):
    store = M.Store(spark, str(tmp_path / "s"), width=1.0, most=3)
    for k in range(6):
        assert M.process(store, batch(spark, (float(k), k)), float(k))
    assert [t for t, _, _ in held(store)] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and len(store.state()["tables"]["events"]) <= 3


def test_stream_merges_files_and_a_second_run_adds_nothing(spark, tmp_path):
    store = M.Store(spark, str(tmp_path / "s"))
    for k in range(2):
        batch(spark, (10.0 * k, 1), (10.0 * k + 5, 2)).withColumn("snapshot_time", F.lit(10.0 * k + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):
        M.stream(spark, str(tmp_path / "in"), store, str(tmp_path / checkpoint)).awaitTermination(120)
        assert [(t, e) for t, _, e in held(store)] == [(0.0, 0), (5.0, 0), (10.0, 1), (15.0, 1)]
