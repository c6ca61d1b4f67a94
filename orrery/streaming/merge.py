"""Incremental merge of rolling event windows: replace, epochs, coverage, append once, late batches.

Each snapshot carries the latest stretch of every stream. Merging replaces what
the new stretch covers. The functions are pure: stored rows and new rows in,
the rows to store out; process() writes those bins of time that change to a new
version folder and then a state that names it, as plain Parquet has no MERGE.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.joins import unseen


def window_replace(old: DataFrame, new: DataFrame, time: str = "t", stored: DataFrame | None = None) -> DataFrame:
    """old with the stretch that new covers replaced, and the epoch of new rows.

    Rows without a time in new are skipped. Stored rows after new's first time m
    go. At m itself the side with more rows stays, new if they are equal. The new
    rows open a new epoch if m lies after all that is stored, and else continue
    the last one. old has the columns of new and epoch (long). stored is a row of
    the last time and epoch, (_last, _epoch), of a history of which old is a part.
    """
    new = new.filter(F.col(time).isNotNull())
    first = new.agg(F.min(time).alias("_m"))
    n_new = new.join(first, F.col(time) == F.col("_m")).agg(F.count(F.lit(1)).alias("_n_new"))
    n_old = old.join(first, F.col(time) == F.col("_m")).agg(F.count(F.lit(1)).alias("_n_old"))
    last = old.agg(F.max(time).alias("_last"), F.max("epoch").alias("_epoch")) if stored is None else stored
    facts = first.crossJoin(n_new).crossJoin(n_old).crossJoin(last)  # one row each
    facts = facts.withColumn("_epoch", F.when(F.col("_last").isNull(), F.coalesce("_epoch", F.lit(0))).when(F.col("_m") > F.col("_last"), F.col("_epoch") + 1).otherwise(F.col("_epoch")).cast("long"))
    facts = F.broadcast(facts)
    kept = old.crossJoin(facts).filter(F.col("_m").isNull() | (F.col(time) < F.col("_m")) | ((F.col(time) == F.col("_m")) & (F.col("_n_new") < F.col("_n_old"))))
    added = new.crossJoin(facts).filter((F.col(time) > F.col("_m")) | ((F.col(time) == F.col("_m")) & (F.col("_n_new") >= F.col("_n_old"))))
    columns = [c for c in old.columns if c != "epoch"]
    return kept.select(*columns, "epoch").unionByName(added.select(*columns, F.col("_epoch").alias("epoch")))


def keyed_replace(old: DataFrame, new: DataFrame, key: str, time: str = "t") -> DataFrame:
    """As window_replace() for each key by itself, without the boundary rule: stored rows from a key's first new time on go. A null key is a key."""
    new = new.filter(F.col(time).isNotNull())
    first = new.groupBy(F.col(key).alias("_key")).agg(F.min(time).alias("_m"))
    kept = old.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_m").isNull() | (F.col(time) < F.col("_m"))).select(*old.columns)
    return kept.unionByName(new.select(*[c for c in old.columns if c in new.columns]), allowMissingColumns=True)


def append_unseen(old: DataFrame, new: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    return old.unionByName(unseen(new, old, on, order).select(*new.columns), allowMissingColumns=True)


def coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    """(stream, epoch, t_min, t_max, window_start): extents grow, the window's start is that of the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("stream", "epoch").agg(F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"), F.max_by("window_start", "_new").alias("window_start"))


def extents(events: DataFrame, stream: str, time: str = "t") -> DataFrame:
    """The coverage of a stream's rows (t, epoch)."""
    return events.groupBy(F.lit(stream).alias("stream"), "epoch").agg(F.min(time).alias("t_min"), F.max(time).alias("t_max"), F.min(time).alias("window_start"))


def is_late(snapshot_time: float | None, high: float | None) -> bool:
    """Whether a whole snapshot is older than what is merged; one without a time is never judged."""
    return snapshot_time is not None and high is not None and snapshot_time < high


def new_only(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """The rows of new whose snapshot old doesn't have."""
    return new.join(old.select(by).distinct(), by, "left_anti")


EVENTS = "t double, ord long, series string, item string, level double"
COVERAGE = "stream string, epoch long, t_min double, t_max double, window_start double"


class Store:
    """Datasets under a root, kept in bins of time, and a small table of states.

    A commit writes the bins from some bin on to a new version folder. A state
    lists, for each dataset, which version holds which range of bins, so a merge
    costs what its window covers and not the history. At `most` ranges a dataset
    is written anew as one. A crash before the state is written leaves the old
    state current. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, width: float = 86400.0, most: int = 64):
        self.spark, self.root, self.width, self.most = spark, root.rstrip("/"), width, most

    def state(self) -> dict:
        try:
            rows = self.spark.read.schema("seq long, state string").json(f"{self.root}/_state").orderBy(F.col("seq").desc()).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return json.loads(rows[0].state) | {"seq": rows[0].seq} if rows else {"seq": 0, "tables": {}, "high": None, "last": None, "epoch": None}

    def bin(self, time: float) -> int:
        return math.floor(time / self.width)

    def read(self, name: str, schema: str, state: dict | None = None, since: int | None = None) -> DataFrame:
        """The rows of a dataset, from bin `since` on. Bins outside are folders that aren't opened."""
        parts = [p for p in (state or self.state())["tables"].get(name, []) if since is None or p[2] is None or p[2] >= since]
        if not parts:
            return self.spark.createDataFrame([], schema)
        held = self.spark.read.schema(f"{schema}, v long, bin long").option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/v={v}" for v, _, _ in parts])
        where = reduce(lambda a, b: a | b, [(F.col("v") == v) & (F.lit(True) if low is None else F.col("bin") >= low) & (F.lit(True) if high is None else F.col("bin") <= high) for v, low, high in parts])
        return held.filter(where if since is None else where & (F.col("bin") >= since)).drop("v", "bin")

    def commit(self, state: dict, tables: dict[str, tuple[DataFrame, str | None, int | None]], **facts) -> dict:
        """Write (rows, time column, first bin) of each dataset in place of what it has from that bin on (None: of all), then the state."""
        seq, parts = state["seq"] + 1, dict(state["tables"])
        for name, (df, time, since) in tables.items():
            kept = [] if since is None else [[v, low, since - 1 if high is None else min(high, since - 1)] for v, low, high in parts.get(name, []) if low is None or low < since]
            df.withColumn("bin", F.floor(F.col(time) / self.width) if time else F.lit(0)).write.mode("overwrite").partitionBy("bin").parquet(f"{self.root}/{name}/v={seq}")
            parts[name] = [*kept, [seq, since, None]]
        told = {k: v for k, v in state.items() if k != "seq"} | facts | {"tables": parts}
        self.spark.createDataFrame([(seq, json.dumps(told))], "seq long, state string").coalesce(1).write.mode("append").json(f"{self.root}/_state")
        return told | {"seq": seq}

    def clean(self) -> None:
        """Delete the versions that the current state doesn't name; no reader of an older one may be at work."""
        for name, parts in self.state()["tables"].items():
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in files.listStatus(folder):
                if found.getPath().getName() not in {f"v={v}" for v, _, _ in parts}:
                    files.delete(found.getPath(), True)


def process(store: Store, batch: DataFrame, snapshot_time: float | None) -> bool:
    """Merge one snapshot's events (EVENTS) into the store; False if it is late.

    A snapshot that is merged again changes nothing, so replays need no record of
    what was merged. Until a snapshot with a time was merged, the newest stored
    event stands for the high-water time.
    """
    state = store.state()
    if is_late(snapshot_time, state["last"] if state["high"] is None else state["high"]):
        return False
    high = state["high"] if snapshot_time is None else snapshot_time
    batch = batch.filter("t IS NOT NULL")
    first, last = batch.agg(F.min("t"), F.max("t")).first()
    if first is None:
        store.commit(state, {}, high=high)
        return True
    since = None if len(state["tables"].get("events", [])) >= store.most else store.bin(first)
    stored = store.spark.createDataFrame([(state["last"], state["epoch"])], "_last double, _epoch long")
    merged = window_replace(store.read("events", f"{EVENTS}, epoch long", state, since), batch, stored=stored)
    epoch = 0 if state["last"] is None else state["epoch"] + (first > state["last"])
    ledger = coverage(store.read("coverage", COVERAGE, state), extents(batch.withColumn("epoch", F.lit(epoch).cast("long")), "events"))
    store.commit(state, {"events": (merged, "t", since), "coverage": (ledger, None, None)}, high=high, last=last, epoch=epoch)
    return True


def stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, schema: str = f"{EVENTS}, snapshot_time double") -> object:
    """A file stream of snapshots in time order, each merged by process(); ends when all files are taken."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for row in batch.select("snapshot_time").distinct().orderBy("snapshot_time").collect():  # a few snapshots a batch
            process(store, batch.filter(F.col("snapshot_time").eqNullSafe(F.lit(row.snapshot_time))).drop("snapshot_time"), row.snapshot_time)

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return reader.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
