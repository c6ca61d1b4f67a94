"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the 3- and 4-byte runs of its lower-cased words, word ends
included. Each hashes to a row of an embedding; the mean of the rows goes through
a softmax. Both are trained together by stochastic gradient descent in numpy, on
a bounded sample of labelled rows; a temperature and the score below which a
prediction is rejected are calibrated on a fifth of the sample that isn't
trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, prepare
from .text import joined, slices

BUCKETS, WIDTH = 1 << 14, 16
#: Letters' bytes stay, all others part words.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages): what a subword adds to the logits, calibrated
    bias: np.ndarray
    reject_below: float


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, how many each text has), in order of the texts. Every text ends in a line break."""
    b = FOLD[data]
    inner = b != 32
    n, found, counts = len(b), [], []
    for size in (3, 4):
        if n < size:
            continue
        key = b[: n - size + 1].copy()
        for k in range(1, size):
            key = (key << np.uint64(8)) | b[k : n - size + 1 + k]
        whole = np.logical_and.reduce([inner[k : n - size + 1 + k] for k in range(1, size - 1)])
        at = np.flatnonzero(whole)  # a text's last byte parts words, so no inner byte lies in another text
        found.append(((key[at] * np.uint64(0x9E3779B97F4A7C15 + 2 * size)) >> np.uint64(50)).astype(np.int32))
        counts.append(np.diff(np.searchsorted(at, offsets)))
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts]), kind="stable")
    return np.concatenate(found)[order], np.sum(counts, axis=0)


def logit_sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the table's rows over each text's subwords, their number)."""
    b = FOLD[data]
    inner = b != 32
    n, total, count = len(b), np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1, np.int64)
    for size in (3, 4):
        if n < size:
            continue
        key = b[: n - size + 1].copy()
        for k in range(1, size):
            key = (key << np.uint64(8)) | b[k : n - size + 1 + k]
        at = np.flatnonzero(np.logical_and.reduce([inner[k : n - size + 1 + k] for k in range(1, size - 1)]))
        bucket = (key[at] * np.uint64(0x9E3779B97F4A7C15 + 2 * size)) >> np.uint64(50)
        to = np.searchsorted(at, offsets)
        some = np.flatnonzero(np.diff(to))
        if len(some):
            for k in range(table.shape[1]):
                total[some, k] += np.add.reduceat(table[:, k][bucket], to[some], dtype=np.float64)
        count += np.diff(to)
    return total, count


def texts_of(batch: pa.RecordBatch, column: int) -> pa.Array:
    return pc.utf8_lower(batch.column(column).fill_null(""))


def features(rows: DataFrame) -> DataFrame:
    """(label, buckets, counts) of rows (label, text): the distinct subword buckets of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = joined(texts_of(batch, 1))
            ids, sizes = subwords(data, offsets)
            out = [np.unique(x, return_counts=True) for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype("<i4").tobytes() for a, _ in out], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in out], pa.binary())], ["label", "buckets", "counts"])

    return rows.mapInArrow(run, "label string, buckets binary, counts binary")


def sample(docs: DataFrame, per_lang: int, most: int, langs: int = 1000) -> DataFrame:
    """At most per_lang rows of each of the `langs` largest languages and `most` in all: those of the least hash of doc_id. Texts are read for these alone."""
    known = docs.filter("lang IS NOT NULL").filter(~held_out()).select("doc_id", "lang")
    key = F.xxhash64("doc_id")
    size = F.broadcast(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n")).orderBy(F.col("_n").desc(), "lang").limit(langs))
    # some 3 * per_lang ids of a language are ranked, however many rows it has
    near = known.join(size, "lang").filter(key / 2.0**64 + 0.5 <= 3 * per_lang / F.col("_n")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(key, "doc_id")
    ids = near.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= per_lang).orderBy("_k", "lang").limit(most).select(F.col("doc_id").alias("_id")).distinct()
    # at most `most` ids
    return docs.filter("lang IS NOT NULL").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select(F.col("lang").alias("label"), "text")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, per_lang: int = 800, most: int = 8000, epochs: int = 12, rate: float = 4.0, right: float = 0.99) -> Model | None:
    """A model of docs (doc_id, text, lang), or None if no row can be learnt from.

    Learns from rows with a language and crc32(doc_id) mod 4 other than 2, at most
    per_lang of a language and `most` in all. reject_below is the least score at
    which a share `right` of the calibration rows that score so high are right.
    """
    prepare(docs.sparkSession)
    rows = [(r.label, np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4")) for r in features(sample(docs, per_lang, most)).collect()]
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(7)
    rng.shuffle(rows)
    y = np.array([langs.index(r[0]) for r in rows])

    def dense(at: np.ndarray) -> np.ndarray:
        x = np.zeros((len(at), BUCKETS), np.float32)
        for k, i in enumerate(at):
            x[k, rows[i][1]] = rows[i][2] / rows[i][2].sum()
        return x

    calibration, training = np.arange(len(rows) // 5), np.arange(len(rows) // 5, len(rows))
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    out[:] = rng.normal(0, 0.1, out.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(training), max(1, len(training) // 32)):
            x = dense(at)
            mean = x @ emb
            wrong = softmax(mean @ out + bias)
            wrong[np.arange(len(at)), y[at]] -= 1
            wrong /= len(at)
            back = wrong @ out.T
            used = np.flatnonzero(x.any(0))
            emb[used] -= step * len(at) * (x[:, used].T @ back)
            out -= step * (mean.T @ wrong)
            bias -= step * 0.1 * wrong.sum(0)
    table = emb @ out
    if len(calibration) < 10:
        return Model(langs, table, bias, 0.0)
    logits = np.vstack([dense(part) @ table + bias for part in np.array_split(calibration, len(calibration) // 64 + 1)])
    own = y[calibration]
    heat = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(own)), own] + 1e-12).mean())
    p = softmax(logits / heat)
    top, good = p.max(1), p.argmax(1) == own
    order = np.argsort(-top)
    share = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(share >= right)
    return Model(langs, table / np.float32(heat), bias / np.float32(heat), float(top[order][enough[-1]]) if len(enough) else 1.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs (doc_id, text; further columns don't matter).

    The whole text counts. A null text, one without letters, or no model: `und`
    with score 0, rejected. Otherwise lang_pred is always a learnt language, and
    rejected tells that its score lies below the calibrated bound. A text whose
    words have fewer than three bytes has the score of the classes' biases. Equal
    rows are returned as often as they come.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS rows of as many floats as there are languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = texts_of(batch, 1)
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            if m is None:
                pred, score, rejected = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                data, offsets = joined(texts)
                logits = np.zeros((len(texts), len(m.langs)))
                for a, b in slices(offsets):
                    total, count = logit_sums(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.table)
                    logits[a:b] = total / np.maximum(count, 1)[:, None]
                p = softmax(logits + m.bias)
                pred = np.where(letters, np.array(m.langs, object)[p.argmax(1)], "und")
                score = np.where(letters, p.max(1), 0.0)
                rejected = ~letters | (score < m.reject_below)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(pred), pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, **options) -> DataFrame:
    """predict() of docs (doc_id, text, lang) by a model fitted on them, with held_out."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), **options)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
