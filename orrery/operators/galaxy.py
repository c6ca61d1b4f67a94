"""The map: where gates lie, what they join and which way, tracks of highways, sunlight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: points that a span of a track is drawn with.
SAMPLES = 16


def tracks(points: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(track, n, x, z): smooth lines through control points (track, k, x, z, tx, tz, inlength, outlength).

    Two points in a row span a cubic Bezier curve whose inner control points lie
    along the tangents, by the first's outlength and the second's inlength. n counts
    from 0, which is the first point itself. A track of one point has no line.
    """
    order = Window.partitionBy("track").orderBy("k")
    nxt = lambda c: F.lead(c).over(order).alias(f"_{c}")
    spans = points.select("track", (F.row_number().over(order) - 1).alias("_span"), "x", "z", "tx", "tz", "outlength", *[nxt(c) for c in ("x", "z", "tx", "tz", "inlength")]).filter("_x IS NOT NULL")
    rows = spans.withColumn("_i", F.explode(F.sequence(F.when(F.col("_span") == 0, 0).otherwise(1), F.lit(samples))))
    t = F.col("_i") / F.lit(float(samples))

    def curve(c: str) -> Column:
        a, d, u = F.col(c), F.col(f"_{c}"), 1 - t
        b, e = a + F.col(f"t{c}") * F.col("outlength"), d - F.col(f"_t{c}") * F.col("_inlength")
        return ((a * u + 3 * t * b) * u + 3 * t * t * e) * u + t * t * t * d

    return rows.select("track", (F.col("_span") * samples + F.col("_i")).alias("n"), curve("x").alias("x"), curve("z").alias("z"))


def sunlit(sectors: DataFrame, sunlight: DataFrame) -> DataFrame:
    """sectors (sector, cluster, ...) with sunlight (macro, sunlight): the sector's own, else its cluster's, else 1."""
    own = lambda key: sunlight.select(F.col("macro").alias(key), F.col("sunlight").alias(f"_{key}"))
    return sectors.join(own("sector"), "sector", "left").join(own("cluster"), "cluster", "left").withColumn("sunlight", F.coalesce("_sector", "_cluster", F.lit(1.0))).drop("_sector", "_cluster")


def sector_of(path: Column) -> Column:
    """The macro of the sector whose connection a path goes through, or null."""
    steps = F.filter(F.split(F.lower(path), "/"), lambda s: s.endswith("_connection") & s.contains("_sector"))
    return F.concat(F.regexp_replace(F.try_element_at(steps, F.lit(1)), "_connection$", ""), F.lit("_macro"))


def located(ends: DataFrame, zones: DataFrame, gates: DataFrame) -> DataFrame:
    """ends (end, path, gate) with sector, x and z: the zone that the path goes through first, and its gate in that zone.

    zones: (name, macro, x, z, ord), of equal names the last counts; gates: (macro,
    name, x, z, ord), offsets in a zone: the gate is the first step behind the zone,
    or else `gate`, that is one of them, and failing that the zone's first. What
    isn't known lies at 0.
    """
    zone = zones.groupBy(F.lower("name").alias("_step")).agg(F.max_by(F.struct(F.lower("macro").alias("macro"), "x", "z"), "ord").alias("zone"))
    named = gates.filter("name IS NOT NULL").groupBy(F.lower("macro").alias("_macro"), F.lower("name").alias("_gate")).agg(F.max_by(F.struct("x", "z"), "ord").alias("_named"))
    first = gates.groupBy(F.lower("macro").alias("_macro")).agg(F.min_by(F.struct("x", "z"), "ord").alias("_first"))
    steps = ends.select("end", F.coalesce("gate", F.lit("")).alias("gate"), F.split(F.lower(F.coalesce("path", F.lit(""))), "/").alias("_steps"))
    hit = steps.select("end", "_steps", "gate", F.posexplode("_steps").alias("_at", "_step")).join(zone, "_step").groupBy("end").agg(F.min_by(F.struct("_at", "zone", "_steps", "gate"), "_at").alias("h"))
    rest = hit.select("end", F.col("h.zone").alias("zone"), F.col("h.zone.macro").alias("_macro"), F.posexplode(F.concat(F.slice("h._steps", F.col("h._at") + 2, F.size("h._steps") + 1), F.array(F.lower("h.gate")))).alias("_k", "_gate"))
    found = rest.join(named, ["_macro", "_gate"]).groupBy("end").agg(F.min_by("_named", "_k").alias("_named"))
    place = hit.select("end", F.col("h.zone").alias("zone"), F.col("h.zone.macro").alias("_macro")).join(found, "end", "left").join(first, "_macro", "left")
    shift = lambda c: F.col(f"zone.{c}") + F.coalesce(F.col("_named")[c], F.col("_first")[c], F.lit(0.0))
    place = place.select("end", shift("x").alias("x"), shift("z").alias("z"))
    return ends.select("end", sector_of(F.col("path")).alias("sector")).join(place, "end", "left").fillna(0.0, ["x", "z"])


def links(jumps: DataFrame, highways: DataFrame, zones: DataFrame, gates: DataFrame) -> DataFrame:
    """(sector_a, sector_b, ax, az, bx, bz, oneway): pairs of sectors that jumps (ord, a_path, b_path) or highways (ord, a_path, b_path, a_gate, b_gate) join.

    A pair stands once, with the lesser name first: as the first jump has it, or
    else the first highway. Highways lead from a to b; oneway is the sector that a
    highway leads to where none leads back, else null. Links within a sector and
    those of an unknown one are left out.
    """
    rows = jumps.select(F.lit(0).alias("rank"), "ord", "a_path", "b_path", F.lit(None).cast("string").alias("a_gate"), F.lit(None).cast("string").alias("b_gate")).unionByName(highways.select(F.lit(1).alias("rank"), "ord", "a_path", "b_path", "a_gate", "b_gate"))
    for end in "ab":
        ends = rows.select(F.struct("rank", "ord").alias("end"), F.col(f"{end}_path").alias("path"), F.col(f"{end}_gate").alias("gate"))
        at = located(ends, zones, gates).select("end.*", F.col("sector").alias(f"sector_{end}"), F.col("x").alias(f"{end}x"), F.col("z").alias(f"{end}z"))
        rows = rows.join(at, ["rank", "ord"])
    rows = rows.filter("sector_a IS NOT NULL AND sector_b IS NOT NULL AND sector_a <> sector_b")
    back = rows.filter("rank = 1").select(F.col("sector_b").alias("sector_a"), F.col("sector_a").alias("sector_b")).distinct().withColumn("_back", F.lit(True))
    rows = rows.join(back, ["sector_a", "sector_b"], "left").withColumn("oneway", F.when((F.col("rank") == 1) & F.col("_back").isNull(), F.col("sector_b")))
    turned = F.col("sector_b") < F.col("sector_a")
    side = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    one = rows.select(F.struct("rank", "ord").alias("_o"), F.least("sector_a", "sector_b").alias("sector_a"), F.greatest("sector_a", "sector_b").alias("sector_b"), side("ax", "bx").alias("ax"), side("az", "bz").alias("az"), side("bx", "ax").alias("bx"), side("bz", "az").alias("bz"), "oneway")
    return one.groupBy("sector_a", "sector_b").agg(F.min_by(F.struct("ax", "az", "bx", "bz", "oneway"), "_o").alias("v")).select("sector_a", "sector_b", "v.*")
