"""World snapshots as tables in a folder: imports of many tables that count together or not at all.

An import writes the rows of each table to a folder of its own, by snapshot (many
snapshots share their folders), and then one ledger row for each snapshot that it
holds. Only what the ledger names is read, so an import that breaks off leaves
nothing behind, and one that brings a snapshot again replaces all tables of it at
once. A snapshot is known by its guid, game time and date; its id is that of its
first import, whatever the number of later ones. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.aggregates import digest

from .merge import new_only

LEDGER = "seq long, save_id long, snapshot long, file string, guid string, game_version string, game_time double, save_date string, modified int, player_name string, player_money_cr double"
IDENTITY = ("guid", "game_time", "save_date")
#: Folders that the snapshots of an import are dealt to: one each, as far as they go.
FOLDERS = 64


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _found(self, path: str, schema: str | None = None) -> DataFrame | None:
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)
        except AnalysisException as e:
            if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            return None

    def ledger(self) -> DataFrame:
        """A row for each import of a snapshot: LEDGER."""
        found = self._found(f"{self.root}/_ledger", LEDGER)
        return self.spark.createDataFrame([], LEDGER) if found is None else found

    def snapshots(self) -> DataFrame:
        """One row a snapshot, with what its first import says of it."""
        return self.ledger().filter("save_id = snapshot").drop("seq", "snapshot")

    def current(self) -> DataFrame:
        """(save_id, game_time) of the snapshot that was imported last: a row, or none."""
        return self.ledger().orderBy(F.desc("save_id")).limit(1).select(F.col("snapshot").alias("save_id"), "game_time")

    def write(self, tables: dict[str, DataFrame], headers: DataFrame) -> DataFrame:
        """Import tables (each with its file) of the snapshots whose headers (file, guid, ...) are given; returns their new ledger rows.

        Imports are numbered on from the last one, by game time and file. Of the
        files of one import that are the same snapshot, that with the greatest
        number counts.
        """
        known = self.ledger()
        seq, last = known.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1, F.coalesce(F.max("save_id"), F.lit(0))).first()
        own = headers.select("file", *[f.name for f in known.schema if f.name in headers.columns and f.name != "file"])
        own = own.withColumns({"seq": F.lit(seq).cast("long"), "save_id": (F.row_number().over(Window.orderBy("game_time", "file")) + last).cast("long")})  # a row for each file
        every = known.select("save_id", *IDENTITY).unionByName(own.withColumn("_own", F.lit(True)), allowMissingColumns=True)
        rows = every.withColumn("snapshot", F.min("save_id").over(Window.partitionBy(*IDENTITY))).filter("_own").select("snapshot", *own.columns)
        rows.write.mode("overwrite").parquet(f"{self.root}/_import/v={seq}")  # numbered once: all tables take their ids from here
        rows = self.spark.read.parquet(f"{self.root}/_import/v={seq}")
        share = -(-rows.select("snapshot").distinct().count() // FOLDERS)
        part = F.floor((F.row_number().over(Window.orderBy("snapshot")) - 1) / share).cast("int")  # a row for each snapshot
        ids = rows.groupBy("snapshot").agg(F.max_by("file", "save_id").alias("file")).select("file", F.col("snapshot").cast("int").alias("save_id"), part.alias("part"))
        for name, df in tables.items():
            own = df.join(ids, "file").drop("file").hint("rebalance", "part").sortWithinPartitions("part", "save_id")
            own.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/_tables/{name}/v={seq}")
        whole = self.spark.createDataFrame([], LEDGER).unionByName(rows, allowMissingColumns=True).coalesce(1)
        whole.write.mode("append").parquet(f"{self.root}/_ledger")  # the import counts from here on
        return whole

    def _valid(self) -> DataFrame:
        return self.ledger().groupBy(F.col("snapshot").alias("save_id")).agg(F.max("seq").alias("v"))

    def read(self, name: str, current: bool = False) -> DataFrame:
        """A table's rows with save_id, of all snapshots or of the current one. Folders that aren't asked for are not opened."""
        found = [df for path in self._paths(name) if (df := self._found(path)) is not None]
        if not found:
            raise ValueError(f"no table {name}")
        wanted = self._valid()
        if current:
            wanted = wanted.join(self.current().select("save_id"), "save_id", "left_semi")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.join(wanted, ["v", "save_id"], "left_semi").drop("v", "part") for df in found])

    def _paths(self, name: str) -> tuple[str, str]:
        """Where a table lies, and where its imports do that have a folder for each snapshot, as all once had."""
        return f"{self.root}/_tables/{name}", f"{self.root}/{name}"

    def aggregate(self, name: str, rows: DataFrame) -> DataFrame:
        """Add a table's rows (save_id, ...) of the snapshots that it doesn't have yet, and return all: a snapshot that is imported again adds nothing."""
        path = f"{self.root}/_{name}"
        old = self._found(path)
        (rows if old is None else new_only(old, rows, "save_id")).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    def clean(self, names: Sequence[str]) -> None:
        """Delete the folders of imports that the ledger doesn't name, or whose snapshots later ones replaced; nobody may be reading."""
        for path, by in ((p, by) for name in names for p, by in zip(self._paths(name), ("part", "save_id"))):
            found = self._found(path)
            kept = set() if found is None else {(r.v, r[by]) for r in found.join(self._valid(), ["v", "save_id"], "left_semi").select("v", by).distinct().collect()}  # some folders of each import
            for v in self._folders(path):
                for s in self._folders(v.toString()):
                    if (int(v.getName().split("=")[1]), int(s.getName().split("=")[1])) not in kept:
                        s.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(s, True)

    def _folders(self, path: str) -> list:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath() for f in files.listStatus(folder) if f.isDirectory() and "=" in f.getPath().getName()] if files.exists(folder) else []


def put_reference(df: DataFrame, root: str, name: str) -> bool:
    """Write a reference table in place of the one of that name, if their rows differ in any way but their order; whether it was written.

    The table that is read is the one that the digests' ledger names last, so a
    write that breaks off leaves the old one.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{name}"
    own = digest(df, sorted(df.columns)).first()
    told = f"{own.n}:{own.digest}:{','.join(f'{f.name} {f.dataType.simpleString()}' for f in sorted(df.schema, key=lambda f: f.name))}"
    had = _references(spark, path)
    if had and had[-1].digest == told:
        return False
    seq = had[-1].seq + 1 if had else 1
    df.write.mode("overwrite").parquet(f"{path}/v={seq}")
    spark.createDataFrame([(seq, told)], "seq int, digest string").coalesce(1).write.mode("append").json(f"{path}/_digests")
    return True


def reference(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{name}"
    return spark.read.parquet(f"{path}/v={_references(spark, path)[-1].seq}")


def _references(spark: SparkSession, path: str) -> list:
    """The versions of a reference table, in order: a few rows."""
    try:
        return spark.read.schema("seq int, digest string").json(f"{path}/_digests").orderBy("seq").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def presence(component: DataFrame) -> DataFrame:
    """(save_id, sector_macro, owner, class, n) of stations and ships; what is absent counts as the empty text."""
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("sector_macro", "owner", "class")]
    return component.filter(F.col("class").startswith("ship_") | (F.col("class") == "station")).groupBy("save_id", *named).agg(F.count("*").alias("n"))


def market(component: DataFrame, offers: DataFrame) -> DataFrame:
    """(save_id, sector_macro, ware, side, n, amount, price_min, price_avg, price_max) of the order books."""
    places = component.select("save_id", F.col("id").alias("object_id"), "sector_macro")
    return offers.join(places, ["save_id", "object_id"], "left").groupBy("save_id", F.coalesce("sector_macro", F.lit("")).alias("sector_macro"), "ware", "side").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min("price_cr").alias("price_min"), F.avg("price_cr").alias("price_avg"), F.max("price_cr").alias("price_max"))
