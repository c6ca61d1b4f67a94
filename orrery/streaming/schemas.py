"""Versions of stored datasets: a chain of steps that bring a store of any version to the newest.

A store's tables are folders, and a ledger says which folder each table has and
what version they are of. An upgrade applies all steps from that version on to
the tables, as one plan, writes those that changed to new folders and then adds
the ledger row; until then the old version is what readers see, so an upgrade
that breaks off is simply done again. Tables that can be made anew from
snapshots are dropped, and so are those that the store once managed and nobody
knows any more; history stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.columns import cents

Tables = dict[str, DataFrame]
Step = Callable[[Tables], Mapping[str, DataFrame | None]]


def widened(**columns: Mapping[str, tuple[str, object]]) -> Step:
    """A step that adds columns (name: (type, value)) to tables."""
    return lambda t: {name: t[name].withColumns({c: F.lit(v).cast(kind) for c, (kind, v) in own.items() if c not in t[name].columns}) for name, own in columns.items() if name in t}


def renamed(table: str, **columns: str) -> Step:
    return lambda t: {table: t[table].withColumnsRenamed(columns)} if table in t else {}


def money_apart(t: Tables) -> Tables:
    """Money entries used to stand among stock levels, without a ware; what they are is in their raw attributes."""
    if "stock_event" not in t:
        return {}
    stock = t["stock_event"]
    money = (F.col("ware") == "") & F.col("raw_attrs").isNotNull()
    raw = lambda name: F.get_json_object("raw_attrs", f"$.{name}")
    found = stock.filter(money).select("time", "owner_id", raw("partner").alias("partner_id"), raw("type").alias("kind"), raw("tradeentry").try_cast("long").alias("tradeentry"), cents(F.coalesce(raw("v2"), raw("v"))).alias("value_cr"), "raw_attrs", "owner_faction", "owner_code", "owner_name", "epoch", "owner_entity")
    out = {"stock_event": stock.filter(~F.coalesce(money, F.lit(False))), "money_event": t["money_event"].unionByName(found, allowMissingColumns=True) if "money_event" in t else found}
    return out | ({"trade_tx": t["trade_tx"].withColumn("kind", F.lit("trade"))} if "trade_tx" in t else {})


COVERAGE = "stream string, epoch long, t_min double, t_max double, window_start double"


def covered(t: Tables) -> Tables:
    """Coverage is taken from the events themselves; what it has is extended, never narrowed. Logs know no epoch: each category is a stream of epoch 0."""
    found = [t[n].groupBy(F.lit(n).alias("stream"), "epoch").agg(F.min("time").alias("t_min"), F.max("time").alias("t_max")) for n in ("trade_tx", "stock_event", "money_event") if n in t]
    if "log_entry" in t:
        found.append(t["log_entry"].groupBy(F.concat(F.lit("log:"), F.coalesce("category", F.lit(""))).alias("stream")).agg(F.min("time").alias("t_min"), F.max("time").alias("t_max")).withColumn("epoch", F.lit(0)))
    if "coverage" in t:
        found.append(t["coverage"])
    if not found:
        return {}
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    if "window_start" not in every.columns:
        every = every.withColumn("window_start", F.lit(None).cast("double"))
    return {"coverage": every.groupBy("stream", F.col("epoch").cast("long").alias("epoch")).agg(F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"), F.max("window_start").alias("window_start"))}


_TEXT, _LONG = ("string", None), ("long", None)
_party = lambda *sides: {f"{s}_{c}": _TEXT for s in sides for c in ("faction", "code", "name")}

#: What each version changes against the one before. Rows from before a column was known have nulls in it, or what is stated.
CHAIN: dict[int, list[Step]] = {
    2: [widened(stock_event=_party("owner") | {"epoch": ("long", 0)}, trade_tx=_party("buyer", "seller") | {"epoch": ("long", 0)})],
    3: [widened(trade_tx={f"{s}_cmdr_{c}": _TEXT for s in ("buyer", "seller") for c in ("id", "name", "code")})],
    4: [widened(trade_tx={f"{s}_entity": _LONG for s in ("buyer", "seller", "buyer_cmdr", "seller_cmdr")}, stock_event={"owner_entity": _LONG})],
    5: [money_apart, widened(money_event=_party("partner") | {"partner_entity": _LONG})],
    6: [covered],
    7: [renamed("log_entry", interact="interaction"), widened(removed_object={"first_save_id": _LONG})],
}
NEWEST = max(CHAIN)
#: Tables of history and of provenance, which an upgrade keeps.
KEPT = ("stock_event", "trade_tx", "money_event", "log_entry", "removed_object", "coverage", "entity", "entity_event", "save", "sector_presence", "station_metric", "market_stat")


@dataclass(frozen=True)
class State:
    seq: int
    version: int | None
    folders: dict[str, str]


class Versioned:
    """Datasets under a root, of one version together. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, chain: Mapping[int, list[Step]] = CHAIN, kept: Iterable[str] = KEPT):
        self.spark, self.root, self.chain, self.kept = spark, root.rstrip("/"), chain, set(kept)

    def state(self) -> State:
        try:
            rows = self.spark.read.schema("seq int, version int, folders string").json(f"{self.root}/_schema").orderBy(F.desc("seq")).limit(1).collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return State(rows[0].seq, rows[0].version, json.loads(rows[0].folders)) if rows else State(0, None, {})

    def tables(self, state: State | None = None) -> Tables:
        return {n: self.spark.read.parquet(f"{self.root}/{f}") for n, f in (state or self.state()).folders.items()}

    def write(self, tables: Mapping[str, DataFrame | None], version: int, state: State | None = None) -> State:
        """Put tables (None: drop it) in place of those of these names, and say what version all are of."""
        was = state or self.state()
        seq, folders = was.seq + 1, dict(was.folders)
        for name, df in tables.items():
            if df is None:
                folders.pop(name, None)
            else:
                folders[name] = f"{name}/v={seq}"
                df.write.mode("overwrite").parquet(f"{self.root}/{folders[name]}")
        self.spark.createDataFrame([(seq, version, json.dumps(folders))], "seq int, version int, folders string").coalesce(1).write.mode("append").json(f"{self.root}/_schema")
        return State(seq, version, folders)

    def upgrade(self, known: Iterable[str] = ()) -> State:
        """Bring the store to the newest version of its chain; known: the tables that are made anew from snapshots, which are dropped, as is what is neither known nor kept.

        A store of the newest version, or without a version, stays as it is; one
        that is newer than the chain is refused.
        """
        was, newest = self.state(), max(self.chain)
        if was.version is None or was.version == newest:
            return was
        if was.version > newest:
            raise ValueError(f"the store is of version {was.version}, newer than {newest}")
        held = {n: df for n, df in self.tables(was).items() if n in self.kept}
        now, changed = dict(held), set()
        for version in range(was.version + 1, newest + 1):
            for step in self.chain[version]:
                for name, df in step(now).items():
                    changed.add(name)
                    if df is None:
                        now.pop(name, None)
                    else:
                        now[name] = df
        gone = {n: None for n in was.folders if n not in self.kept}
        return self.write(gone | {n: now.get(n) for n in sorted(changed)}, newest, was)
