"""What the text operators share: inputs, Arrow batch sizes and cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker holds a few MB of text at once; workers can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    here = spark.sparkContext.environment.get("PYTHONPATH", "")
    if REPO not in here.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{REPO}:{here}".rstrip(":")
    return spark


def shared(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="orrery-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{shared(spark)}/orrery-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as a table and read from there: smaller than a checkpoint, and read by size and column."""
    df.write.parquet(path := shared_path(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(left: DataFrame, right: DataFrame, key: str | list[str], size: str, share: int = 1000) -> DataFrame:
    """left joined with right on key (a column or several), of which right has each value once, with how many rows of left have it (size).

    Values of over one in `share` rows are broadcast, so that no task gets all
    rows of a common one: at most `share` rows, whatever left's size.
    """
    least = max((right.agg(F.sum(size)).first()[0] or 0) // share, 1)
    common, rare = right.filter(F.col(size) > least).drop(size), right.filter(F.col(size) <= least).drop(size)
    often = left.join(F.broadcast(common), key)
    return often.unionByName(left.join(F.broadcast(common.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(rare, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc(column: str = "doc_id"):
    """crc32 of an id written as text; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0))


def held_out(column: str = "doc_id"):
    return crc(column) % 4 == 2
