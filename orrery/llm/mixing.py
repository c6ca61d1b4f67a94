"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of its documents that gives it its
target share of the characters. Each document's number of copies is a Poisson
number of that mean: the inverse of the distribution function at a uniform value
hashed from a seed and the doc_id, so any task, run or engine draws the same.
Copies are then ordered by a second hash across all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A value in [0, 1) hashed from the parts: the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, growth: float = 1.0) -> DataFrame:
    """(source, rate) of docs (source, text).

    weights: (source, weight), those to mix to; a source without a weight, or of
    weight 0, gets rate 0. Without weights a source's weight is its characters to
    `power`. In expectation the mixture has `growth` times the characters of all
    documents. A null source is a source of its own; one without characters gets rate 0.
    """
    size = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    if weights is None:
        size = size.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        w = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("weight"))
        size = size.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    all_ = size.agg(F.sum("size").alias("_size"), F.sum("weight").alias("_weight"))
    rate = F.when((F.col("size") > 0) & (F.col("_weight") > 0), F.col("weight") / F.col("_weight") * F.col("_size") * growth / F.col("size")).otherwise(0.0)
    return size.join(F.broadcast(all_), F.lit(True)).select("source", rate.alias("rate"))  # one row


def distributions(rate: DataFrame) -> DataFrame:
    """(source, upto): for each rate, P(copies <= k) for k from 0 to where the rest can't be told from nothing."""
    most = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 20)
    k = rate.select("source", "rate", F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("k"))
    rows = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    k = k.withColumn("p", F.when(F.col("rate") == 0, F.when(F.col("k") == 0, 1.0).otherwise(0.0)).otherwise(F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(rows))))
    k = k.withColumn("upto", F.sum("p").over(rows))
    return k.groupBy("source").agg(F.array_sort(F.collect_list("upto")).alias("upto"))  # tens of values


#: Sources whose distributions are broadcast (some 50 numbers each); the rows of more sources are dealt by source.
BROADCAST_SOURCES = 100_000


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 11, names: tuple[str, str] = ("copy", "shuffle_key"), **options) -> DataFrame:
    """docs (doc_id, text, source and any others) with each row as often as drawn, in an order of no meaning.

    Added columns, called by `names` and in place of any of that name: the copy
    (1, 2, ...) and the key by which rows are dealt to partitions and sorted in
    them. Null and empty texts take part like others, with the rate of their
    source. Rows with equal doc_ids draw the same number; a null doc_id draws as
    the text `null`. An empty table gives an empty result.
    """
    known = distributions(rates(docs.select("source", "text"), weights, **options)).select(F.col("source").alias("__mix_source"), F.col("upto").alias("__mix_upto"))
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    doc_id = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    drawn = docs.withColumn("__mix_u", uniform(F.lit(str(seed)), doc_id)).join(known, docs["source"].eqNullSafe(known["__mix_source"]), "left")
    n = F.size(F.filter("__mix_upto", lambda p: p <= F.col("__mix_u"))).cast("long")
    copies = drawn.withColumn(names[0], F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))).drop("__mix_source", "__mix_upto", "__mix_u")
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), doc_id, names[0]))
    return copies.withColumn(names[1], key).repartitionByRange(names[1]).sortWithinPartitions(names[1])


def sql(seed: int = 11, power: float = 0.5, growth: float = 1.0) -> str:
    """DuckDB SQL for mix(documents) without weights: doc_id, source, copy, shuffle_key, text_md5."""
    return f"""
WITH size AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
     w AS (SELECT source, size, pow(size, {power}) AS weight, sum(size) OVER () AS all_size FROM size),
     rate AS (SELECT source, CASE WHEN size > 0 THEN weight / sum(weight) OVER () * all_size * {growth} / size ELSE 0 END AS rate FROM w),
     k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 10 * sqrt(rate) + 20)::BIGINT)) AS k FROM rate),
     p AS (SELECT source, k, CASE WHEN rate = 0 THEN (k = 0)::INT::DOUBLE ELSE exp(k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k)) END AS p FROM k),
     upto AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM p),
     u AS (SELECT doc_id, source, md5(text) AS text_md5, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS u FROM documents),
     n AS (SELECT doc_id, u.source, text_md5, (SELECT count(*) FROM upto WHERE upto.source IS NOT DISTINCT FROM u.source AND upto.upto <= u.u) AS n FROM u)
SELECT doc_id, source, text_md5, copy, md5('{seed}-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key
FROM (SELECT doc_id, source, text_md5, unnest(generate_series(1, n)) AS copy FROM n WHERE n > 0)"""
