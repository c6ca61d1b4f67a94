"""Removal of lines that many documents share: lines are exploded, hashed and counted, and texts put together again by position.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case. Keys are compared by two XXH64 of different seeds, 128 bits together. A
document is told which positions it loses, so texts are shuffled once, with
those positions, and lines never are. Counts per key are summed before the
shuffle; keys that many documents lose are broadcast, as no more than a fixed
number of keys can be that common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Common keys (some 40 bytes each) that are broadcast whole; more are joined by a shuffle.
BROADCAST_KEYS = 250_000


def pieces(text: Column) -> Column:
    """The lines of a text: a null or empty one has one, which is empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, chars: int) -> DataFrame:
    """(doc, row, at, h1, h2): each line of docs (doc, row, text) whose key has `chars` code points or more."""
    lines = docs.select("doc", "row", F.posexplode(pieces(F.col("text"))).alias("at", "line"))
    keys = lines.select("doc", "row", "at", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.char_length("key") >= chars)
    key = F.translate("key", UPPER, LOWER)
    return keys.select("doc", "row", "at", F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


def common_keys(found: DataFrame, documents: int) -> DataFrame:
    """(h1, h2, n, last): keys of found (doc, h1, h2) that so many different documents have, how many lines they are and the greatest document."""
    each = found.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"))
    keys = each.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.max("doc").alias("last"))
    return keys.filter(F.col("docs") >= documents).drop("docs")


def deduplicated(docs: DataFrame, chars: int = 40, documents: int = 5) -> DataFrame:
    """docs (doc_id, text and any others) with n_lines, n_dropped and kept_text in place of any columns so called.

    Lines whose key has `chars` code points or more and is found in `documents`
    different doc_ids or more go, but for those of the greatest of these doc_ids.
    n_lines counts the lines before. The lines that stay are joined by line
    breaks; a text that loses all its lines becomes empty. A null or empty text is
    one empty line. Rows that share a doc_id are one document, and so are those
    without a doc_id, which are less than all others. Rows are returned as often
    as they come; an empty table gives an empty result.
    """
    own = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__text": F.coalesce(F.col("text").cast("string"), F.lit(""))}).withColumn("__row", F.xxhash64("__text"))
    found = occurrences(own.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), F.col("__text").alias("text")), chars)
    common = stored(common_keys(found, documents))
    if common.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        lost = found.join(F.broadcast(common), ["h1", "h2"])
    else:
        lost = looked_up(found, common, ["h1", "h2"], "n")
    lost = lost.filter(F.col("doc").isNull() | (F.col("doc") < F.col("last")))
    # a list has positions of one text at most, however many rows have that text
    lost = lost.groupBy(F.col("doc").alias("__d"), F.col("row").alias("__r")).agg(F.collect_set("at").alias("__lost"))
    told = own.join(lost, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")), "left")
    # a row for each array of lines: what stands above the generator reads that array, and doesn't split again for each line
    told = told.withColumn("__lines", F.explode(F.array(pieces(F.col("__text")))))
    n = F.size("__lines")
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), n - 1), "__lost"))
    kept = F.array_join(F.transform(stay, lambda k: F.col("__lines")[k]), "\n")
    out = {"n_lines": n.cast("long"), "n_dropped": F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long"), "kept_text": F.when(F.col("__lost").isNull(), F.col("__text")).otherwise(kept)}
    return told.select(*[c for c in docs.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of deduplicated(docs)."""
    return deduplicated(docs.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def sql(chars: int = 40, documents: int = 5) -> str:
    """DuckDB SQL for digests(documents)."""
    return f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     line AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS k FROM split),
     keyed AS (SELECT doc_id, line, k, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM line),
     common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {documents}),
     marked AS (SELECT doc_id, line, k, coalesce(last <> doc_id, false) AS gone FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
