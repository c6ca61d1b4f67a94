"""Durable identities: components of a snapshot matched with entities of the registry.

Within a slot (code, class) components are taken in order and claim open entities
of an equal spawn time: one of the same macro and owner first, then of the same
macro, then of the same owner, then any, the least recently seen of these. Failing
that the most recently seen closed entity of the same code, class and spawn time is
reopened; failing that a new one is made. Only components and entities of one code,
class and spawn time compete. Where there is one of either, a window ranks the
claims; what is left goes group by group through claim(), in a time that grows with
the group's size and not with its square.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPONENT = "ord long, id string, code string, class string, macro string, owner string, name string, spawntime double"
ENTITY = "entity_id long, code string, class string, macro string, owner string, name string, spawntime double, first_seen double, last_seen double, gone_time double, gone_reason string"
EVENT = "entity_id long, kind string, t double, was string, now string"
BLOCK = 1 << 16  # order numbers to a block when new entities are numbered


def plain(x):
    return None if pd.isna(x) else x


def claim(components: Iterable[tuple], entities: Iterable[tuple]) -> list[tuple[int, int]]:
    """(ord, entity_id) of the claims in one group: components (ord, macro, owner), entities (entity_id, macro, owner, last_seen, open).

    Open entities wait in a heap for each way to be looked up; one that was taken
    is skipped when its turn comes in another heap.
    """
    heaps, taken, out = defaultdict(list), set(), []
    for e, macro, owner, seen, is_open in entities:
        if is_open:
            for key in ((macro, owner), ("macro", macro, 0), ("owner", owner, 0), ()):
                heaps[key].append((seen, e))
        else:
            heaps["closed"].append((-seen, -e))
    for heap in heaps.values():
        heapq.heapify(heap)
    for n, macro, owner in sorted(components):
        for key in ((macro, owner), ("macro", macro, 0), ("owner", owner, 0), (), "closed"):
            heap = heaps.get(key, [])
            while heap and abs(heap[0][1]) in taken:
                heapq.heappop(heap)
            if heap:
                e = abs(heapq.heappop(heap)[1])
                taken.add(e)
                out.append((n, e))
                break
    return out


def kept(components: DataFrame) -> DataFrame:
    """Components that have an identity: ships, stations and build storages with a code, wherever they are connected."""
    return components.filter((F.col("code") != "") & (F.col("class").startswith("ship_") | F.col("class").isin("station", "buildstorage")))


def matches(components: DataFrame, entities: DataFrame) -> DataFrame:
    """(ord, entity_id): the claims of all groups; components that claim nothing are absent."""
    key = F.struct("code", "class", "spawntime").alias("grp")  # in a struct, so that nulls are equal
    c = kept(components).select(F.to_json(key, {"ignoreNullFields": "false"}).alias("grp"), "ord", F.col("macro").alias("c_macro"), F.col("owner").alias("c_owner"))
    e = entities.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("grp"), "entity_id", F.col("macro").alias("e_macro"), F.col("owner").alias("e_owner"), "last_seen", F.col("gone_time").isNull().alias("open"))
    sizes = c.groupBy("grp").agg(F.count("ord").alias("n_c")).join(e.groupBy("grp").agg(F.count("entity_id").alias("n_e")), "grp")
    simple, mixed = sizes.filter("n_c = 1 OR n_e = 1").select("grp"), sizes.filter("n_c > 1 AND n_e > 1").select("grp")

    better = [F.col("open").desc(), (F.col("open") & F.col("c_macro").eqNullSafe(F.col("e_macro"))).desc(), (F.col("open") & F.col("c_owner").eqNullSafe(F.col("e_owner"))).desc()]
    age = [F.when(F.col("open"), F.col("last_seen")).otherwise(-F.col("last_seen")), F.when(F.col("open"), F.col("entity_id")).otherwise(-F.col("entity_id"))]
    w = Window.partitionBy("grp").orderBy("ord", *better, *age)
    first = simple.join(c, "grp").join(e, "grp").withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("ord", "entity_id")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        comps = [(n, plain(m), plain(o)) for n, m, o in zip(left["ord"], left["c_macro"], left["c_owner"])]
        known = [(n, plain(m), plain(o), s, a) for n, m, o, s, a in zip(right["entity_id"], right["e_macro"], right["e_owner"], right["last_seen"], right["open"])]
        return pd.DataFrame(claim(comps, known), columns=["ord", "entity_id"], dtype="int64")

    rest = c.join(mixed, "grp", "left_semi").groupBy("grp").cogroup(e.join(mixed, "grp", "left_semi").groupBy("grp")).applyInPandas(run, "ord long, entity_id long")
    return first.unionByName(rest)


def numbered(df: DataFrame, base: int, name: str) -> DataFrame:
    """df with numbers from base + 1 on, in order of ord: each block of order numbers by itself, behind the sum of the blocks before it."""
    block = F.floor(F.col("ord") / BLOCK).alias("_block")
    before = df.groupBy(block).agg(F.count(F.lit(1)).alias("_n"))  # a row a block
    before = before.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("ord"))
    return df.withColumn("_block", block).join(before, "_block").withColumn(name, (F.lit(base) + F.col("_before") + own).cast("long")).drop("_block", "_before")


def reconcile(components: DataFrame, entities: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, mapping (ord, id, entity_id), events EVENT) after a snapshot at `now`.

    An entity keeps its macro, and takes its component's owner and name; a change
    of these is an event. Entities that nothing claims close: as recycled if their
    slot got a new entity, else as disappeared. A snapshot older than the registry
    changes nothing: its components are only mapped, to null where a new entity
    would be. Needs a checkpoint folder: the claims are settled once.
    """
    spark = entities.sparkSession
    facts = entities.agg(F.max(F.greatest("last_seen", "gone_time")).alias("seen"), F.max("entity_id").alias("top")).first()
    found = kept(components).join(matches(components, entities).withColumnRenamed("entity_id", "_old"), "ord", "left")
    if facts.seen is not None and now < facts.seen:
        return entities, found.select("ord", "id", F.col("_old").alias("entity_id")), spark.createDataFrame([], EVENT)
    found = found.checkpoint()
    told, minted = found.filter("_old IS NOT NULL").withColumn("entity_id", F.col("_old")), numbered(found.filter("_old IS NULL"), facts.top or 0, "entity_id")
    alive = [F.lit(now).alias("last_seen"), F.lit(None).cast("double").alias("gone_time"), F.lit(None).cast("string").alias("gone_reason")]
    pair = told.alias("c").join(entities.alias("e"), "entity_id")
    seen = pair.select("entity_id", "e.code", "e.class", "e.macro", "c.owner", "c.name", "e.spawntime", "e.first_seen", *alive)
    fresh = minted.select("entity_id", "code", "class", "macro", "owner", "name", "spawntime", F.lit(now).alias("first_seen"), *alive)
    slots = found.filter("_old IS NULL").select("code", "class").distinct().withColumn("_minted", F.lit(True))
    left = entities.join(told.select("entity_id"), "entity_id", "left_anti").join(slots, ["code", "class"], "left")
    closes = F.col("gone_time").isNull()
    left = left.withColumns({"gone_reason": F.when(closes, F.when(F.col("_minted"), "recycled").otherwise("disappeared")).otherwise(F.col("gone_reason")), "gone_time": F.coalesce("gone_time", F.lit(now))})
    registry = seen.unionByName(fresh).unionByName(left.select(*entities.columns))
    mapping = told.select("ord", "id", "entity_id").unionByName(minted.select("ord", "id", "entity_id"))
    change = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"e.{field}").alias("was"), F.col(f"c.{field}").alias("now")) for kind, field in (("captured", "owner"), ("renamed", "name"))])
    events = pair.select("entity_id", F.explode(F.filter(change, lambda x: ~x["was"].eqNullSafe(x["now"]))).alias("x")).select("entity_id", "x.kind", F.lit(now).alias("t"), "x.was", "x.now")
    return registry, mapping, events
