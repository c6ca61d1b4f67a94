import heapq
import math
import random

from orrery.operators import graph as G
from orrery.plans.relational import checkpoints


def along(gates, fast, sector, x, z, to):
    """(cost, plain, quick) of the fastest way by a search over all gates from one place."""
    ends = [((a, ax, az), (b, bx, bz)) for a, b, ax, az, bx, bz in gates]
    across = [*ends, *[(v, u) for u, v in ends]]
    heap, seen = [((0.0, 0.0, 0.0), (sector, x, z))], set()

    def leg(way, p, q):
        km, quick = math.dist(p[1:], q[1:]) / 1000, p[0] in fast
        return way[0] + km * (0.1 if quick else 1), way[1] + km * (not quick), way[2] + km * quick

    found = []
    while heap:
        way, p = heapq.heappop(heap)
        if p in seen:
            continue
        seen.add(p)
        if p[0] == to[0]:
            found.append(leg(way, p, to))
        for u, v in across:
            if u[0] == p[0]:
                heapq.heappush(heap, (leg(way, p, u), v))
    return min(found, default=None)


def test_routes_are_the_fastest_ways(spark):
    checkpoints(spark)
    rnd = random.Random(4)
    place = lambda: float(rnd.randrange(-90, 90) * 1000)
    gates = [(*rnd.sample("abcdefgh", 2), place(), place(), place(), place()) for _ in range(11)] + [("y", "z", 0.0, 0.0, 1000.0, 0.0)]
    fast = {"b", "e"}
    stations = [(f"s{k}", rnd.choice("abcdefghyzw"), place(), place()) for k in range(16)]
    st = spark.createDataFrame(stations, "station string, sector string, x double, z double")
    g = spark.createDataFrame(gates, "sector_a string, sector_b string, ax double, az double, bx double, bz double")
    sectors = spark.createDataFrame([(c, c in fast) for c in "abcdefghyz"], "sector string, highway boolean")
    wanted = st.selectExpr("station AS source").crossJoin(st.selectExpr("station AS target")).filter("source <> target")
    for highways in (True, False):
        got = {(r.source, r.target): (r.plain_km, r.highway_km) for r in G.routes(st, g, sectors, wanted, highways).collect()}
        n = 0
        for a in stations:
            for b in stations:
                if a == b:
                    continue
                quick = fast if highways else set()
                way = along(gates, quick, *a[1:], b[1:]) if a[1] != b[1] else ((0, 0, math.dist(a[2:], b[2:]) / 1000) if a[1] in quick else (0, math.dist(a[2:], b[2:]) / 1000, 0))
                assert (way is None) == ((a[0], b[0]) not in got)
                if way:
                    n += 1
                    assert math.isclose(sum(got[a[0], b[0]]), way[1] + way[2], abs_tol=1e-6) and math.isclose(got[a[0], b[0]][0], way[1], abs_tol=1e-6)
        assert n > 50


def test_tags_of_one_owner_join_over_any_chain(spark):
    checkpoints(spark)
    chain = [(1, k, f"t{k + d}") for k in range(9) for d in (0, 1)] + [(2, 1, "t5"), (2, 2, "t6")]
    found = {(r.owner, r.tag): r.grp for r in G.tag_groups(spark.createDataFrame(chain, "owner int, store int, tag string")).collect()}
    assert found == {(1, f"t{k}"): "t0" for k in range(10)} | {(2, "t5"): "t5", (2, "t6"): "t6"}
