"""Bringing in what is older: plans for replaying archived snapshots, and rows of a former log that lie before the stored ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .merge import Store, process

IDENTITY = ("guid", "game_time", "save_date")


def plan(found: DataFrame, known: DataFrame) -> DataFrame:
    """(guid, turn, file, game_time, action) for archived files found (file, guid, game_time, save_date), given the snapshots known (guid, game_time, save_date, covered).

    Files are taken playthrough by playthrough in the order of game time. Those
    whose snapshot is covered (its aggregates are stored) are skipped, and so are
    further files of one snapshot. The last import leaves its world behind, which
    must not be older than the newest that is known: a playthrough whose imports
    would all be older is refused, unless a file of the newest is among those
    given, which is then imported once more at the end (`restore`). Files without
    a guid are `unreadable`, one that is still being written (temp) is `busy`.
    turn counts what is to be done, from 1.
    """
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]
    told = known.groupBy(*[F.col(c).alias(f"_{c}") for c in IDENTITY]).agg(F.max(F.col("covered").cast("int")).alias("_covered"))
    head = known.groupBy(F.col("guid").alias("_head_guid")).agg(F.max("game_time").alias("_head"))
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    rows = found.join(told, same[0] & same[1] & same[2], "left").join(head, F.col("guid") == F.col("_head_guid"), "left")
    alike = Window.partitionBy(*IDENTITY).orderBy("file")
    rows = rows.withColumn("_first", F.row_number().over(alike) == 1)
    rows = rows.withColumn("action", F.when(F.contains(name, F.lit("temp")), "busy").when(F.col("guid").isNull(), "unreadable").when((F.coalesce("_covered", F.lit(0)) == 1) | ~F.col("_first"), "skip").otherwise("import"))
    own = Window.partitionBy("guid")
    readable = F.col("action").isin("import", "skip")
    facts = {"_last": F.max(F.when(F.col("action") == "import", F.col("game_time"))).over(own), "_newest": F.max(F.when(readable, F.struct("game_time", "file"))).over(own)}
    rows = rows.withColumns(facts)
    behind = F.col("_last") < F.col("_head")
    refused = behind & (F.col("_newest.game_time") < F.col("_head"))
    again = behind & ~refused & (F.col("file") == F.col("_newest.file")) & (F.col("action") == "skip")
    rows = rows.withColumn("action", F.when(refused & (F.col("action") == "import"), "refuse").when(again, "restore").otherwise(F.col("action")))
    todo = F.col("action").isin("import", "restore")
    turn = F.when(todo, F.count(F.when(todo, 1)).over(Window.partitionBy("guid").orderBy("game_time", "file").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("guid", turn.cast("int").alias("turn"), "file", "game_time", "action")


def replay(planned: DataFrame, stores: Callable[[str], Store], load: Callable[[str], DataFrame]) -> list[tuple[str, bool]]:
    """Merge what is planned, in its order, into the store of each playthrough; (file, whether its events were merged): those older than what is merged already are not."""
    todo = planned.filter("turn IS NOT NULL").orderBy("guid", "turn").collect()  # a row for each file
    return [(row.file, process(stores(row.guid), load(row.file), row.game_time)) for row in todo]


def older(stored: DataFrame, former: DataFrame, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Rows of a former log that lie before the first stored one of their kind (by; nulls are a kind), and all of kinds that aren't stored. Those without a time are left out.

    Once they are stored nothing lies before the first, so they come in once.
    """
    first = stored.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(time).alias("_first"))
    rows = former.filter(F.col(time).isNotNull())
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = rows.join(first, same, "left")
    else:
        rows = rows.join(F.broadcast(first), F.lit(True), "left")  # a row
    return rows.filter(F.col("_first").isNull() | (F.col(time) < F.col("_first"))).select(*former.columns)


def former_log(spark: SparkSession, base: str) -> DataFrame | None:
    """The tab-separated table of a former log: <base>.csv.gz, or else <base>.csv; texts, empty ones null; None where there is neither."""
    for path in (f"{base}.csv.gz", f"{base}.csv"):
        try:
            return spark.read.option("sep", "\t").option("header", "true").csv(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None
