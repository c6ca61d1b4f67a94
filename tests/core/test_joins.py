"""Rules of joins on small tables that are worked out by hand."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from orrery.operators import joins as J


def test_first_leader_is_found_without_pairs(spark):
    followers = spark.createDataFrame([("f", "a"), ("g", "a"), ("g", "b"), ("h", "b"), ("i", "c"), ("j", "d"), ("k", None)], "follower string, conn string")
    leaders = spark.createDataFrame([(9, 1.0, "a"), (7, 2.0, "a"), (8, None, "b"), (5, 1.0, "c"), (5, 0.0, "c"), (3, 1.0, None), (4, 1.0, "z")], "leader int, rank double, conn string")
    found = J.first_leader(followers, leaders, "conn", "follower", "leader", ["rank", "leader"])
    assert sorted((r.follower, r.leader, r.rank, r.conflict) for r in found.collect()) == [("f", 9, 1.0, True), ("g", 8, None, True), ("h", 8, None, False), ("i", 5, 0.0, False)]
    assert re.search(r"\bJoin Inner.*\bAggregate\b", found._jdf.queryExecution().optimizedPlan().toString(), re.S)  # leaders are cut down before
    many = spark.range(30_000).select(F.col("id").alias("leader"), F.lit("a").alias("conn"))
    crowd = spark.range(30_000).select(F.col("id").alias("follower"), F.lit("a").alias("conn"))
    assert [tuple(r) for r in J.first_leader(crowd, many, "conn", "follower", "leader", ["leader"]).groupBy("leader", "conflict").count().collect()] == [(0, True, 30_000)]
