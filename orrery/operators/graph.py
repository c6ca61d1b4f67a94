"""Graph operators: containment and fleet trees, adjacency, hop distances, fastest routes, tag groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """(root, member, depth) of all chains of edges (leader, follower), at most `most` deep, so a cycle ends; lineage is cut every fourth level."""
    now = edges.select(F.col("leader").alias("root"), F.col("follower").alias("member"), F.lit(1).alias("depth"))
    every, step = now, edges.select(F.col("leader").alias("member"), F.col("follower").alias("_next"))
    for depth in range(2, most + 1):
        now = now.join(step, "member").select("root", F.col("_next").alias("member"), F.lit(depth).alias("depth"))
        if depth % 4 == 0:
            now = now.checkpoint()
        if now.isEmpty():
            break
        every = every.unionByName(now)
    return every


def adjacency(gates: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) both ways: gates (a, b), and all members (node, cluster) of a cluster with each other."""
    x, y = members.select(F.col("node").alias("a"), "cluster"), members.select(F.col("node").alias("b"), "cluster")
    near = x.join(y, "cluster").filter("a <> b").select("a", "b")
    return gates.select("a", "b").union(gates.select("b", "a")).union(near).filter("a <> b").distinct()


def hops(edges: DataFrame, sources: DataFrame, most: int = 6) -> DataFrame:
    """(source, node, hops): breadth-first distances up to `most` over edges (a, b) from sources (source)."""
    front = sources.select(F.col("source"), F.col("source").alias("node"), F.lit(0).alias("hops"))
    seen = front
    for k in range(1, most + 1):
        step = front.join(edges, front["node"] == edges["a"]).select("source", F.col("b").alias("node")).distinct()
        front = step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(k))
        if k % 2 == 0:
            front = front.checkpoint()
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
        if k % 4 == 0:
            seen = seen.checkpoint()
    return seen


def nearest(found: DataFrame) -> DataFrame:
    """(node, hops): the least over all sources."""
    return found.groupBy("node").agg(F.min("hops").alias("hops"))


HIGHWAY = 0.1  # time of a highway kilometre against a plain one


def between(x: str, y: str) -> Column:
    """Kilometres between two places of one sector, in metres."""
    return F.hypot(F.col(f"{x}.x") - F.col(f"{y}.x"), F.col(f"{x}.z") - F.col(f"{y}.z")) / 1000


def legs(km: Column, quick: Column) -> Column:
    """(cost, plain, quick) of a straight line: a highway's kilometres cost less time."""
    plain, fast = F.when(quick, 0.0).otherwise(km), F.when(quick, km).otherwise(0.0)
    return F.struct((plain + fast * HIGHWAY).alias("cost"), plain.alias("plain"), fast.alias("quick"))


def added(*parts: str) -> Column:
    return F.struct(*[sum(F.col(f"{p}.{c}") for p in parts).alias(c) for c in ("cost", "plain", "quick")])


def gate_routes(gates: DataFrame, sectors: DataFrame, starts: DataFrame) -> DataFrame:
    """(a, b, way): the fastest ways from the gates of some sectors (sector) to all gates that can be reached.

    gates: (sector_a, sector_b, ax, az, bx, bz), passed both ways in no time;
    sectors: (sector, highway). A gate is a struct of sector, x and z. Each round
    goes on through one more gate from those that were reached faster than before,
    until there are none. Needs a checkpoint folder.
    """
    end = lambda e: F.struct(F.col(f"sector_{e}").alias("sector"), F.col(f"{e}x").cast("double").alias("x"), F.col(f"{e}z").cast("double").alias("z"))
    through = gates.select(end("a").alias("u"), end("b").alias("v"))
    through = through.unionByName(through.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    points = through.select(F.col("u").alias("p")).distinct()
    quick = F.coalesce("highway", F.lit(False))
    hop = through.join(points.alias("q"), F.col("v.sector") == F.col("q.p.sector")).join(sectors.withColumnRenamed("sector", "_s"), F.col("v.sector") == F.col("_s"), "left")
    hop = hop.select("u", F.col("q.p").alias("to"), legs(F.hypot(F.col("v.x") - F.col("q.p.x"), F.col("v.z") - F.col("q.p.z")) / 1000, quick).alias("leg")).checkpoint()
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("cost", "plain", "quick")])
    best = front = points.join(starts, F.col("p.sector") == F.col("sector"), "left_semi").select(F.col("p").alias("a"), F.col("p").alias("b"), none.alias("way"))
    while True:
        step = front.join(hop, front["b"] == hop["u"]).select("a", F.col("to").alias("b"), added("way", "leg").alias("_new")).groupBy("a", "b").agg(F.min("_new").alias("_new"))
        front = step.join(best, ["a", "b"], "left").filter("way IS NULL OR _new.cost < way.cost - 1e-9").select("a", "b", F.col("_new").alias("way")).checkpoint()
        if front.isEmpty():
            return best
        best = best.unionByName(front).groupBy("a", "b").agg(F.min("way").alias("way")).checkpoint()


def routes(stations: DataFrame, gates: DataFrame, sectors: DataFrame, wanted: DataFrame, highways: bool = True) -> DataFrame:
    """(source, target, plain_km, highway_km) of the fastest way of each wanted pair (source, target) of stations (station, sector, x, z).

    Within a sector the way is a straight line; pairs without a way are absent. The
    gate graph is settled once from the sources' sectors (see gate_routes), and a
    pair then meets the few gates at its two ends.
    """
    sectors = sectors.select("sector", "highway" if highways else F.lit(False).alias("highway"))
    here = stations.join(sectors, "sector", "left").select("station", F.struct("sector", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")).alias("at"), F.coalesce("highway", F.lit(False)).alias("fast"))
    pairs = wanted.join(here.select(F.col("station").alias("source"), F.col("at").alias("s"), F.col("fast").alias("s_fast")), "source").join(here.select(F.col("station").alias("target"), F.col("at").alias("d"), F.col("fast").alias("d_fast")), "target")
    near = pairs.filter("s.sector = d.sector").select("source", "target", legs(between("s", "d"), F.col("s_fast")).alias("way"))
    away = pairs.filter("s.sector <> d.sector")
    ways = gate_routes(gates, sectors, away.select("s.sector").distinct())
    far = away.join(ways, (F.col("s.sector") == F.col("a.sector")) & (F.col("d.sector") == F.col("b.sector")))
    far = far.withColumns({"_from": legs(between("s", "a"), F.col("s_fast")), "_to": legs(between("b", "d"), F.col("d_fast"))})
    far = far.groupBy("source", "target").agg(F.min(added("_from", "way", "_to")).alias("way"))
    return near.unionByName(far).select("source", "target", F.col("way.plain").alias("plain_km"), F.col("way.quick").alias("highway_km"))


def tag_groups(tags: DataFrame) -> DataFrame:
    """(owner, tag, grp): tags of one owner that share a store, over (owner, store, tag), are one group, named by its least tag. Goes on until no label changes."""
    label = tags.select("owner", "store", "tag").distinct().withColumn("grp", F.col("tag"))
    while True:
        by_store = label.groupBy("owner", "store").agg(F.min("grp").alias("_s"))
        now = label.join(by_store, ["owner", "store"]).withColumn("_g", F.least("grp", "_s")).drop("_s")
        by_tag = now.groupBy("owner", "tag").agg(F.min("_g").alias("_t"))
        now = now.join(by_tag, ["owner", "tag"]).withColumn("_g", F.least("_g", "_t")).drop("_t").checkpoint()
        label, moved = now.select("owner", "store", "tag", F.col("_g").alias("grp")), now.filter("_g <> grp")
        if moved.isEmpty():
            return label.select("owner", "tag", "grp").distinct()
