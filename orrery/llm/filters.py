"""Audit of how filters interact: what each removes in every order, and what it alone would have.

Each document gets a mask of the filters that it fails. Its doings in all orders
follow from the mask, so documents are counted by part and mask, and only these
counts meet the orders.

Identical texts are found by partition refinement. Documents are split by their
number of code points and then, class by class, by the hash of one block of the
text after another; a class of one document is dropped after each split. Of the
classes that are left whole texts are compared, and the documents that don't
have the least id of an equal text are marked.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored

FILTERS = "ABCDE"
#: Code points of the blocks that classes are split by, one after another; the last block is what is left of a text.
BLOCKS = (64, 1024, None)
#: Classes (eight bytes each) that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_CLASSES = 500_000
#: Bits of a mask for texts that come again, and for the labels.
REPEAT, GOOD, TOXIC = 16, 32, 64
_BLANK, _MARK, _UPPER = "[\\x20\\x09-\\x0D]+", "[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for the filters A to D, which look at one text alone."""
    words = F.array_remove(F.split(text, _BLANK), "")
    n, chars = F.size(words), F.char_length(text)
    upper = chars - F.char_length(F.translate(text, _UPPER, ""))
    fails = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * upper.cast("long") > 5 * chars.cast("long"), text.rlike(_MARK))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def signature() -> dict[str, Column]:
    """chars and b0, b1, ...: the code points of the column text and the hashes of its blocks."""
    out, at = {"chars": F.char_length("text").cast("long")}, 1
    for k, size in enumerate(BLOCKS):
        out[f"b{k}"] = block_hash(F.substr("text", F.lit(at)) if size is None else F.substr("text", F.lit(at), F.lit(size)))
        at += size or 0
    return out


def plain(docs: DataFrame) -> DataFrame:
    """(doc, part, text) of docs (doc_id, text, source): null texts and sources are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in (("source", "part"), ("text", "text"))])


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc, mask and others) with the labels' bits in the mask. Of several labels of a doc_id one that is 1 counts."""
    bit = lambda c, b: F.max(F.when(F.col(c) == 1, b).otherwise(0))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("__doc")).agg((bit("quality", GOOD) + bit("toxic", TOXIC)).alias("__bits")).filter("__bits > 0")
    return rows.join(told, F.col("doc") == F.col("__doc"), "left").withColumn("mask", F.col("mask") + F.coalesce("__bits", F.lit(0))).drop("__doc", "__bits")


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, part, mask, chars, b0, b1, ...): what one reading of the texts tells of each row of docs, with its labels' bits."""
    return labelled(plain(docs).select("doc", "part", failures(F.col("text")).alias("mask"), *[v.alias(k) for k, v in signature().items()]), labels)


def refined(rows: DataFrame) -> DataFrame:
    """(class, doc, part, mask) of the rows of facts() whose class still has two rows or more after the last block."""
    own = rows.withColumn("class", F.col("chars"))
    for b in (None, *(c for c in rows.columns if c[0] == "b")):
        if b:
            own = own.withColumn("class", F.xxhash64("class", b))
        shared = stored(own.groupBy("class").agg(F.count("*").alias("rows")).filter("rows > 1"))
        own = stored(looked_up(own, shared, "class", "rows"))  # so that a class of very many copies isn't one task's
    return own.select("class", "doc", "part", "mask")


def classed(docs: DataFrame) -> DataFrame:
    """plain(docs) with the class that refined() ends with."""
    own = plain(docs).withColumns(signature()).withColumn("class", F.col("chars"))
    for k in range(len(BLOCKS)):
        own = own.withColumn("class", F.xxhash64("class", f"b{k}"))
    return own.select("doc", "part", "text", "class")


def repeats(docs: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """(part, mask) of each of rows (facts() of docs) whose text is also that of a smaller doc_id."""
    left = stored(refined(rows))
    classes = left.select("class").distinct()
    if classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        classes = F.broadcast(classes)
    texts = classed(docs).join(classes, "class", "left_semi")
    each = texts.groupBy("class", "text").agg(F.min("doc").alias("least"))  # compares whole texts, before the shuffle too
    least = stored(each.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least")))
    later = F.col("least").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("least")))
    one = least.filter("texts = 1").join(left.groupBy("class").agg(F.count("*").alias("rows")), "class")
    marks = looked_up(left, one, "class", "rows").filter(later).select("part", "mask")
    unlike = least.filter("texts > 1").select("class")
    if unlike.isEmpty():
        return marks
    mixed = texts.join(unlike, "class", "left_semi")  # hashes met by chance: here the text itself is the class
    own = mixed.join(mixed.groupBy("class", "text").agg(F.min("doc").alias("least")), ["class", "text"]).filter(later)
    return marks.unionByName(labelled(own.select("doc", "part", failures(F.col("text")).alias("mask")), labels).select("part", "mask"))


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n): rows of docs by part, the filters that they fail and their labels."""
    rows = stored(facts(docs, labels))
    again = repeats(docs, labels, rows).groupBy("part", "mask").agg(F.count("*").alias("n"))
    moved = again.select("part", F.col("mask") + REPEAT, "n").union(again.select("part", "mask", -F.col("n")))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n")).union(moved).groupBy("part", "mask").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of docs (doc_id, text, source).

    A row for each part (source; a null one is the empty one), order of the
    filters and step in it. The filters fail a document that A: has under 50
    words, B: has fewer than 65 different words in 100, C: has over 5 characters
    A-Z in 100 code points, D: holds one of #$%&*|, E: has the text of a smaller
    doc_id. Each row is a document: rows with the same doc_id and text don't
    repeat each other, a null doc_id is greater than all others, null ones among
    themselves are alike. Null and empty texts are one text. Labels (doc_id,
    quality, toxic) may miss, repeat or be null; a null doc_id has none. Every part has all 600 rows; an
    empty table gives an empty result. Further columns don't matter.
    """
    sets = range(1 << len(FILTERS))
    fails = F.col("mask").bitwiseAND(len(sets) - 1)
    own = stored(counts(docs, labels)).withColumn("without", F.explode(F.array(*map(F.lit, sets))))
    free = fails.bitwiseAND(F.col("without")) == 0  # what passes all filters of a set
    total = lambda *b: F.sum(F.when(free & (F.col("mask").bitwiseAND(b[0]) > 0 if b else F.lit(True)), F.col("n")).otherwise(0))
    sums = own.groupBy("part", "without").agg(total().alias("all"), total(GOOD).alias("good"), total(TOXIC).alias("toxic"))
    sums = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("without", "all", "good", "toxic"))).alias("passing"))  # one for each set
    n = lambda s: F.col("passing")[s]["all"]
    last = len(FILTERS) - 1
    share = [sum((factorial(s.bit_count()) * factorial(last - s.bit_count()) * (n(s) - n(s | 1 << f)) for s in sets if not s >> f & 1), F.lit(0)) for f in range(len(FILTERS))]
    only = [n(sets[-1] ^ 1 << f) - n(sets[-1]) for f in range(len(FILTERS))]
    parts = sums.select("part", "passing", F.array(*share).alias("shares"), F.array(*only).alias("only"))
    order = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    rows = parts.withColumn("filter_order", F.explode(order)).withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(FILTERS))])))
    place = [F.instr("filter_order", f) for f in FILTERS]
    before, now = (sum((F.when(p < F.col("step") + k, 1 << f).otherwise(0) for f, p in enumerate(place)), F.lit(0)) for k in (0, 1))
    rows = rows.withColumns({"filter": F.substr("filter_order", F.col("step"), F.lit(1)), "before": F.col("passing")[before], "now": F.col("passing")[now]})
    f = F.ascii("filter") - ord(FILTERS[0])
    failing = n(0) - F.col("passing")[now - before]["all"]  # the step's filter alone
    removed = F.col("before.all") - F.col("now.all")
    found = {"kept": F.col("now.all"), "removed": removed, "redundant": failing - removed, "unique_fails": F.col("only")[f], "good_lost": F.col("before.good") - F.col("now.good"), "toxic_lost": F.col("before.toxic") - F.col("now.toxic"), "shapley": F.col("shares")[f]}
    return rows.select("part", "filter_order", "step", "filter", *[v.cast("long").alias(k) for k, v in found.items()])


def sql() -> str:
    """DuckDB SQL for audit(documents, labels)."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
    return f"""
WITH own AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                  concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
                         CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
                         CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END,
                         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                         CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
                FROM own LEFT JOIN label USING (doc_id)),
     n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL),
     rule AS (SELECT o AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM (VALUES {orders}) AS x(o)),
     each AS (SELECT part, filter_order, step, o.filter_order[step] AS filter, fails, n, good, toxic,
                list_min(list_transform(string_split(fails, ''), lambda c: CASE WHEN c = '' THEN 9 ELSE strpos(filter_order, c) END)) AS falls
              FROM n, rule AS o)
SELECT part, filter_order, step,
  sum(CASE WHEN fails = '' OR falls > step THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN falls = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN contains(fails, filter) AND falls < step THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN falls = step THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN falls = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(sum(CASE WHEN falls = step THEN n ELSE 0 END)) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM each GROUP BY part, filter_order, step, filter"""
