"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of code points, ORDER in a row, over an open vocabulary: every code
point can come, in any script. Counts are sharded Spark tables of grams (as
strings, so that equal means equal) and grow with the trusted text.

The logarithm of an interpolated model is a sum over grams: a gram adds what it
gains over its shorter one (`v`), and as a context what it leaves to shorter
ones. So each gram has one value, and a text's bits are the values of its grams
of all orders. All orders' values of one longest gram are a sum as well (`w`).
Grams of all orders met most often (HEAD at most, whatever the model's size) are
broadcast, and settle most places where the text is read; grams that a bitmap of
fixed size rules out aren't in the model; all others are counted for each text
and joined with the sharded values.

A text is judged by the trusted texts of the other half (by a hash of the text),
so trusted documents, which set the bounds, don't know themselves. A document
goes if its bits per code point lie outside its language's quantiles of trusted
documents: above the upper one (noise) or below the lower one (endless repeats).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, stored
from .decontaminate import SLOTS, _in, bitmap
from .text import hashed, joined, mix, slices

ORDER = 5
#: Trusted ids up to this number are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Grams whose values are broadcast, in a table of 12 bytes for each of 4 * HEAD places.
HEAD = 1 << 19
#: Code points there are, and those (no characters) that stand before a text and after it.
POINTS, START, END = 0x110000, 0xFDD0, 0xFDD1
_BASE = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(ORDER)], np.uint64)
_SALT = mix(np.arange(2 * (ORDER + 1), dtype=np.uint64).reshape(2, ORDER + 1) + np.uint64(77))  # by half and length
KEY = ["half", "gram"]


def _texts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = joined(batch.column(column))
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def halves(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 or 1 for each text, by its bytes."""
    return (hashed(data, offsets[:-1], offsets[1:] - 1) >> np.uint64(7) & np.uint64(1)).astype(np.int64)


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, where those to be predicted are, the text of each of these): ORDER - 1 times START precedes each text and END, to be predicted too, follows."""
    lead = (data & 0xC0) != 0x80
    to = np.concatenate([[0], np.cumsum(lead)])[offsets]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    points[(points == 0) | (points == START) | (points == END)] = 0xFFFD
    points[to[1:] - 1] = END  # in place of the line break
    doc = np.repeat(np.arange(len(to) - 1), np.diff(to))
    at = np.arange(len(points)) + (ORDER - 1) * (doc + 1)
    s = np.full(len(points) + (ORDER - 1) * (len(to) - 1), START, np.uint32)
    s[at] = points
    return s, at, doc


def keys(s: np.ndarray, at: np.ndarray, half: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` code points that end at each place."""
    if 2 * len(at) > len(s):
        every = s * _BASE[0]
        for k in range(1, size):
            every[k:] += s[:-k] * _BASE[k]
        out = every[at]
    else:
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out += s[at - k] * _BASE[k]
    return mix(out ^ np.where(half, *_SALT[::-1, size]))


def strings(s: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The `size` code points that end at each place."""
    return pa.array(np.ascontiguousarray(s[at[:, None] + np.arange(1 - size, 1)]).view(f"<U{size}").ravel().astype(object), pa.string())


def counts(docs: DataFrame) -> DataFrame:
    """(half, gram, n): how often each ORDER code points in a row come in all texts of docs (text), summed for each few MB before the shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, data, offsets in _texts(batch, 0, 4 << 20):
                s, at, doc = sequence(data, offsets)
                half = halves(data, offsets)[doc]
                _, one, n = np.unique(keys(s, at, half, ORDER), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(half[one].astype(np.int32)), strings(s, at[one], ORDER), pa.array(n)], ["half", "gram", "n"])

    some = docs.filter("text IS NOT NULL AND text <> ''").select("text").mapInArrow(run, "half int, gram string, n long")
    return some.groupBy(*KEY).agg(F.sum("n").alias("n"))


def few_of(grams: list[DataFrame]) -> list[dict]:
    """{(half, n): grams of that count} for n from 1 to 4, of the tables (half, gram, n) of each order."""
    rows = reduce(DataFrame.union, [g.filter("n <= 4").groupBy("half", "n").agg(F.count("*").alias("m")).select(F.lit(k).alias("k"), "half", "n", "m") for k, g in enumerate(grams)]).collect()  # eight of each order
    return [{(r["half"], r["n"]): r["m"] for r in rows if r["k"] == k} for k in range(len(grams))]


def discounts(few: dict) -> Column:
    """What each gram of one order (half, gram, n) gives up, by few_of() that order."""
    out = F.lit(0.0)
    for half in (0, 1):
        n1, n2, n3, n4 = (float(few.get((half, k), 0)) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [min(max(k - (k + 1) * y * b / a if a else k * 0.5, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        out = F.when(F.col("half") == half, F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(out)
    return out


def model(trusted: DataFrame) -> tuple[list[DataFrame], np.ndarray, np.ndarray]:
    """(tables, opening, base) of trusted (text).

    tables: (half, gram, p, v, w, n) for each order from 1 on; p is the
    probability of a gram's last code point after the ones before it. opening:
    the bits that each half's texts begin with. base: those of a code point
    outside each half's vocabulary.
    """
    grams = [stored(counts(trusted))]
    for size in range(ORDER - 1, 0, -1):  # a shorter gram counts the code points that are met before it
        grams.insert(0, stored(grams[0].groupBy("half", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n"))))
    off = [g.withColumns({"d": discounts(few), "context": F.substring("gram", 1, k)}) for k, (g, few) in enumerate(zip(grams, few_of(grams)))]
    contexts = [g.groupBy("half", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("rest")) for g in off]
    log = lambda x: -F.log2(x)
    opening, base = np.zeros(2), np.full(2, np.log2(POINTS))
    for r in reduce(DataFrame.union, [c.filter(F.col("context") == chr(START) * k) for k, c in enumerate(contexts)]).collect():  # two rows of each order
        (opening if r["context"] else base)[r["half"]] -= np.log2(r["rest"])
    tables: list[DataFrame] = []
    for k, g in enumerate(off):
        g = g.join(contexts[k], ["half", "context"]).withColumn("share", (F.col("n") - F.col("d")) / F.col("total"))
        if k:
            shorter = tables[-1].select("half", F.col("gram").alias("lower"), F.col("p").alias("p_"), F.col("w").alias("w_"))
            g = g.withColumn("lower", F.substring("gram", 2, k)).join(shorter, ["half", "lower"])
        else:
            g = g.withColumns({"p_": F.lit(1 / POINTS), "w_": F.lit(0.0)})
        g = g.withColumn("p", F.col("share") + F.col("rest") * F.col("p_")).select(*KEY, "n", "p", "w_", log(F.col("p") / F.col("rest") / F.col("p_")).alias("gain"))
        if k + 1 < ORDER:
            left = contexts[k + 1].select("half", F.col("context").alias("gram"), log("rest").alias("left"))
            g = g.join(left, KEY, "left")
        else:
            g = g.withColumn("left", F.lit(0.0))
        g = g.withColumn("v", F.col("gain") + F.coalesce("left", F.lit(0.0)))
        tables.append(stored(g.select(*KEY, "p", "v", (F.col("v") + F.col("w_")).alias("w"), "n")))
    return tables, opening, base


def values_of(tables: list[DataFrame]) -> DataFrame:
    """(half, gram, hash, v, sent, n) of all grams; sent: of the longest grams w, of others v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(0).to_numpy().astype(np.int64)
            grams = np.array(batch.column(1).to_pylist(), f"<U{ORDER}")
            points = grams.view(np.uint32).reshape(-1, ORDER)
            size, h = (points != 0).sum(1), np.zeros(len(half), np.uint64)
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                h[own] = keys(points[own].ravel(), np.arange(k - 1, len(own) * ORDER, ORDER), half[own], int(k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], [*batch.schema.names, "hash"])

    every = reduce(DataFrame.union, [t.select(*KEY, "v", (F.col("w") if k + 1 == ORDER else F.col("v")).alias("sent"), "n") for k, t in enumerate(tables)])
    return stored(every.mapInArrow(run, "half int, gram string, v double, sent double, n long, hash long"))


class Head:
    """A table of hashes and their values, open to lookups of many at once."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(key) + 1))))
        self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        slot, left, self.steps = self._slot(key), np.arange(len(key)), 0
        while len(left):  # those that find their place taken move on by one
            free = left[self.key[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            self.key[slot[free[one]]], self.value[slot[free[one]]] = key[free[one]], value[free[one]]
            left = left[self.key[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of each, 0 where there is none; whether there is one)."""
        slot = self._slot(key)
        had = self.key[slot]
        found = had == key
        value = np.where(found, self.value[slot], np.float32(0))
        left = np.flatnonzero(~found & (had != 0))
        for _ in range(self.steps):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            had = self.key[slot[left]]
            hit = had == key[left]
            value[left[hit]], found[left[hit]] = self.value[slot[left[hit]]], True
            left = left[~hit & (had != 0)]
        return value, found


def frequent(values: DataFrame) -> Head:
    """The grams met most often, at most HEAD of them."""
    steps = values.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("m")).orderBy(F.desc("step")).collect()  # some 500 rows at most
    upto = np.cumsum([r["m"] for r in steps])
    some = [r["step"] for r, m in zip(steps, upto) if m <= HEAD]
    if not some:
        return Head(np.zeros(0, np.uint64), np.zeros(0))
    top = values.filter(F.floor(F.log2("n") * 8) >= min(some)).select("hash", "sent").toArrow()
    return Head(top["hash"].to_numpy().view(np.uint64), top["sent"].to_numpy())


def bits(docs: DataFrame, values: DataFrame, opening: np.ndarray, base: np.ndarray, carry: list[str]) -> DataFrame:
    """carry of docs (text, ...) with __q_n, the code points of the text, and __q_bits, the mean bits of these and its end (null without any)."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast((frequent(values), bitmap(values.select("hash")), opening, base))
    place = docs.columns.index("text")
    gram = [("gram", pa.string()), ("n", pa.int32())]
    inner = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.IntegerType())])
    added = [("__q_n", T.LongType()), ("__q_sum", T.DoubleType()), ("__q_half", T.IntegerType()), ("__q_row", T.LongType()), ("__q_open", T.ArrayType(inner))]
    schema = T.StructType([*docs.select(*carry).schema.fields, *(T.StructField(*x) for x in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, known, opening, base = sent.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            total, size, model_of = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            owner, grams, number = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for a, b, data, offsets in _texts(batch, place, 2 << 20):
                s, at, doc = sequence(data, offsets)
                other = 1 - halves(data, offsets)
                size[a:b], model_of[a:b] = np.bincount(doc, minlength=b - a) - 1, other
                half = other[doc]
                cost, found = head.find(keys(s, at, half, ORDER))
                total[a:b] = opening[other] + base[other] * (size[a:b] + 1) + np.add.reduceat(cost, np.cumsum(size[a:b] + 1) - size[a:b] - 1, dtype=np.float64)
                at, doc, half = at[~found], doc[~found], half[~found]
                for k in range(ORDER, 0, -1):
                    h = keys(s, at, half, k)
                    cost, found = head.find(h) if k < ORDER else (np.zeros(len(h)), np.zeros(len(h), bool))
                    total[a:b] += np.bincount(doc, cost, b - a)
                    maybe = np.flatnonzero(~found & _in(known, h & np.uint64(SLOTS - 1)) & _in(known, h >> np.uint64(32) & np.uint64(SLOTS - 1)))
                    maybe = maybe[np.lexsort((h[maybe], doc[maybe]))]
                    if len(maybe):
                        new = np.flatnonzero(np.concatenate([[True], (np.diff(doc[maybe]) != 0) | (h[maybe][1:] != h[maybe][:-1])]))
                        owner.append(doc[maybe[new]] + a)
                        grams.append(strings(s, at[maybe[new]], k))
                        number.append(np.diff([*new, len(maybe)]))
            owner = np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            listed = pa.concat_arrays(grams).take(pa.array(order)) if grams else pa.array([], pa.string())
            open_ = pa.StructArray.from_arrays([listed, pa.array(np.concatenate(number)[order].astype(np.int32))], fields=list(pa.struct(gram)))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(batch.num_rows + 1)).astype(np.int32)), open_)
            ids = row + np.arange(batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in carry), pa.array(size), pa.array(total), pa.array(model_of), pa.array(ids), lists], [*carry, *(x[0] for x in added)])

    read = stored(docs.mapInArrow(run, schema))  # so that a row keeps its number
    grams = read.select("__q_row", F.col("__q_half").alias("half"), F.explode("__q_open").alias("g")).select("__q_row", "half", "g.gram", F.col("g.n").alias("m"))
    more = stored(grams.join(values.select(*KEY, "v"), KEY).groupBy(F.col("__q_row").alias("__q_of")).agg(F.sum(F.col("m") * F.col("v")).alias("__q_more")))
    out = read.join(more, F.col("__q_row") == F.col("__q_of"), "left")
    mean = F.when(F.col("__q_n") > 0, (F.col("__q_sum") + F.coalesce("__q_more", F.lit(0.0))) / (F.col("__q_n") + 1))
    return out.select(*carry, "__q_n", mean.alias("__q_bits"))


def quantiles(scored: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """(lang, lo, hi, n) of scored (lang, bits): the values, to a thousandth, at these quantiles, from a histogram.

    A language of fewer than `least` rows gets the quantiles of all rows, which
    also come as the row of the null language; a null lang counts as that.
    """
    step = F.round(F.col("bits") * 1000).cast("long")
    hist = scored.filter("bits IS NOT NULL").groupBy("lang", step.alias("v")).agg(F.count("*").alias("n"))
    hist = hist.filter("lang IS NOT NULL").union(hist.groupBy(F.lit(None).cast("string").alias("lang"), "v").agg(F.sum("n").alias("n")))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("v"))
    of = F.sum("n").over(Window.partitionBy("lang"))
    ends = hist.withColumns({"upto": upto, "of": of}).groupBy("lang").agg(
        F.min(F.when(F.col("upto") >= F.col("of") * low, F.col("v"))).alias("lo"), F.min(F.when(F.col("upto") >= F.col("of") * high, F.col("v"))).alias("hi"), F.max("of").alias("n")
    )
    return ends.filter((F.col("n") >= least) | F.col("lang").isNull()).select("lang", (F.col("lo") / 1000).alias("lo"), (F.col("hi") / 1000).alias("hi"), "n")


def trusted_of(docs: DataFrame, labels: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs that labels (doc_id, quality) call good; with how="left" all rows, and the good ones' __q_id."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("__q_id")).distinct()
    small = good.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(good) if small else good, F.col("doc_id") == F.col("__q_id"), how)


def judged(docs: DataFrame, labels: DataFrame, carry: list[str], low: float = 0.001, high: float = 0.995, slack: float = 0.02, least: int = 200) -> DataFrame:
    """carry of docs (doc_id, lang, text, ...) with __q_n, __q_bits, __q_lo, __q_hi and __q_keep; see classify()."""
    some = docs.select(*dict.fromkeys([*carry, "doc_id", "lang", "text"])).withColumns({"__q_lang": F.col("lang").cast("string"), "text": F.col("text").cast("string")})
    tables, opening, base = model(trusted_of(some, labels).select("text"))
    marked = trusted_of(some, labels, "left").withColumn("__q_good", F.col("__q_id").isNotNull()).drop("__q_id")
    out = bits(marked, values_of(tables), opening, base, [*carry, "__q_lang", "__q_good"])
    ends = stored(quantiles(out.filter("__q_good").select(F.col("__q_lang").alias("lang"), F.col("__q_bits").alias("bits")), low, high, least))
    every = ends.filter("lang IS NULL").select(F.col("lo").alias("__q_all_lo"), F.col("hi").alias("__q_all_hi"))
    own = ends.filter("lang IS NOT NULL").select(F.col("lang").alias("__q_of"), F.col("lo").alias("__q_own_lo"), F.col("hi").alias("__q_own_hi"))
    out = out.join(F.broadcast(own), F.col("__q_lang") == F.col("__q_of"), "left")  # a row for each language of at least `least` documents
    out = out.join(F.broadcast(every), F.lit(True), "left")  # one row
    lo = F.coalesce("__q_own_lo", "__q_all_lo", F.lit(float("-inf"))) - slack
    hi = F.coalesce("__q_own_hi", "__q_all_hi", F.lit(float("inf"))) + slack
    return out.select(*(out[c] for c in carry), "__q_n", "__q_bits", lo.alias("__q_lo"), hi.alias("__q_hi"), F.coalesce(F.col("__q_bits").between(lo, hi), F.lit(False)).alias("__q_keep"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, lo, hi, keep) of every row of docs (doc_id, lang, text; further columns don't matter).

    Trusted text is that of all documents with quality 1 in labels (doc_id,
    quality). A symbol is a code point; perplexity is two to the power of the mean
    bits of the text's symbols and its end. keep: the mean lies between the
    quantiles `low` and `high` of trusted documents of the language, give or take
    `slack` bits (lo, hi, as perplexities); a language with fewer than `least` of
    them, and a null one, has the bounds of all languages. A text that is null or
    empty has no perplexity and isn't kept. If there is no trusted text at all,
    everything with text is kept. Bounds belong to what is kept, so ties at them
    stay. Equal rows are returned as often as they come; a null doc_id is never
    trusted; an empty table gives an empty result.
    """
    base = F.lit(2.0)
    return judged(docs, labels, ["doc_id", "lang"], **options).select("doc_id", "lang", F.col("__q_n").alias("n_symbols"), F.pow(base, "__q_bits").alias("perplexity"), F.pow(base, "__q_lo").alias("lo"), F.pow(base, "__q_hi").alias("hi"), F.col("__q_keep").alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of docs that classify() keeps, with all their columns."""
    return judged(docs, labels, docs.columns, **options).filter("__q_keep").select(*docs.columns)
