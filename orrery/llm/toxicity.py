"""Toxicity by weak supervision.

Voters are lexicons (of whole words, and of words' first 4, 5 and 6 bytes, each
in bands by how strongly they mark a label) and patterns of the text. A
generative label model estimates each voter's accuracy on either class and the
voters' correlations by expectation maximisation over their votes, and gives
each text a posterior label. A linear classifier is trained on those posteriors
and scores all texts.

Everything is learnt on a bounded sample of labelled rows; the labels of the
sample choose the lexicons' entries and the classes' starting share, the label
model itself sees votes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, prepare
from .text import hashed, joined, slices, spans

#: Letters' bytes make words.
APART = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
PREFIXES, BANDS = (0, 4, 5, 6), 4  # 0: the whole word
PATTERNS = ("capitals", "bangs", "marks", "digits")
SLOTS = 1 << 16


@dataclass
class Model:
    entries: np.ndarray  # sorted hashes of all lexicons
    voter: np.ndarray  # of each entry
    cuts: np.ndarray  # of each pattern: above it the voter speaks
    weights: np.ndarray
    bias: float


def stems(data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(start of each word, its hash as a whole and by its first bytes; 0 where the word is no longer than that)."""
    start, end = spans(data, APART)
    out = []
    for k, size in enumerate(PREFIXES):
        h = hashed(data, start, np.minimum(end, start + size) if size else end) * np.uint64(2 * k + 3)
        out.append(np.where(end - start > size, h, np.uint64(0)) if size else h)
    return start, out


def patterns(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, PATTERNS): shares of bytes."""
    n = np.maximum(np.diff(offsets) - 1, 1)
    flags = [(raw >= 65) & (raw <= 90), raw == 33, (raw >= 33) & (raw < 48) & (raw != 44) & (raw != 46), (raw >= 48) & (raw < 58)]
    return np.stack([np.add.reduceat(f, offsets[:-1], dtype=np.int64) / n for f in flags], 1)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, lower-cased bytes, their offsets, patterns) of a few MB of texts at a time."""
    texts = batch.column(column).fill_null("")
    raw, at = joined(texts)
    data, offsets = joined(pc.utf8_lower(texts))
    for a, b in slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], patterns(raw[at[a] : at[b]], at[a : b + 1] - at[a])


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, hit, miss): how many rows (label, text) of label 1 and 0 hold each stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy()
            for a, b, data, offsets, _ in _chunks(batch, 1):
                start, kinds = stems(data)
                to = np.searchsorted(start, offsets)
                found = [np.unique(np.concatenate([k[i:j] for k in kinds])) for i, j in zip(to[:-1], to[1:])]
                owner, every = np.repeat(label[a:b], [len(x) for x in found]), np.concatenate(found)
                stem, inverse = np.unique(every, return_inverse=True)
                hit = np.bincount(inverse[owner == 1], minlength=len(stem))
                yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), pa.array(hit), pa.array(np.bincount(inverse, minlength=len(stem)) - hit)], ["stem", "hit", "miss"])

    return rows.mapInArrow(run, "stem long, hit long, miss long").groupBy("stem").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))


def lexicons(rows: DataFrame, share: float, odds: float, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(entries, band of each): stems that toxic rows (label, text) hold far more often than chance, in BANDS by how often.

    Chance allows for the number of stems: their likelihood ratio against the
    sample's share of toxic texts has to exceed the logarithm of that number by 5.
    odds: other labelled rows for each of the sample, over toxic ones for each.
    most: the size of the lexicons at most, those of the greatest ratio. Stems are
    counted where the texts are; these entries alone come to the driver.
    """
    every = cut(stem_counts(rows))
    chance = float(np.log(every.count() + 1) + 5)
    n, hit, miss = F.col("hit") + F.col("miss"), F.col("hit"), F.col("miss")
    ratio = hit * F.log(F.greatest(hit, F.lit(1)) / (n * share)) + miss * F.log(F.greatest(miss, F.lit(1)) / (n * (1 - share)))
    good = every.filter((F.col("stem") != 0) & (hit > 8 * odds * miss)).select("stem", ratio.alias("ratio")).filter(F.col("ratio") > chance)
    found = [r["stem"] for r in good.orderBy(F.desc("ratio"), "stem").limit(most).collect()]
    entries = np.array(found, np.int64).view(np.uint64)
    band = np.arange(len(entries)) * BANDS // max(len(entries), 1)
    order = np.argsort(entries)
    return entries[order], band[order]


def hits(data: np.ndarray, offsets: np.ndarray, entries: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, kinds * BANDS) hits of each lexicon, and words of each text."""
    start, kinds = stems(data)
    to = np.searchsorted(start, offsets)
    words = np.diff(to)
    doc = np.repeat(np.arange(len(words)), words)
    out = np.zeros((len(words), len(PREFIXES) * BANDS), np.int64)
    filled = np.zeros(SLOTS, bool)
    filled[entries % np.uint64(SLOTS)] = True
    for k, h in enumerate(kinds):
        at = np.flatnonzero(filled[(h % np.uint64(SLOTS)).astype(np.int64)])
        if len(at) and len(entries):
            place = np.minimum(np.searchsorted(entries, h[at]), len(entries) - 1)
            own = entries[place] == h[at]
            np.add.at(out, (doc[at[own]], k * BANDS + band[place[own]]), 1)
    return out, words


def votes(hit: np.ndarray, words: np.ndarray, pattern: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """+1 (toxic), -1 or 0 (silent) by each voter: a lexicon speaks where it has an entry, a pattern above its cut, and the last voter, -1, where 20 words or more are in no lexicon."""
    none = (hit.sum(1) == 0) & (words >= 20)
    return np.hstack([np.where(hit > 0, 1, 0), np.where(pattern > cuts, 1, 0), np.where(none, -1, 0)[:, None]])


def label_model(v: np.ndarray, start: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, P(vote | class) of each voter, correlation of the voters given the class).

    Voters that agree beyond what the class explains count for less: a voter's
    weight is one over the root of the sum of its correlations. A silent voter tells nothing.
    """
    cast = np.stack([v == k for k in (-1, 0, 1)], 2).astype(float)
    told = cast * np.array([1, 0, 1])
    table, corr, weight = np.full((2, v.shape[1], 3), 1 / 3), np.eye(v.shape[1]), np.full(v.shape[1], 0.5)
    spoke = (v[:, : len(PREFIXES) * BANDS] > 0).sum(1)
    p = np.where(spoke > 0, 1 - 0.4**spoke, np.where(v[:, -1] < 0, start / 10, start))  # to begin with
    weight[-1] = 1
    for k in range(rounds):
        for c, own in enumerate((1 - p, p)):
            table[c] = (np.einsum("i,ijk->jk", own, cast) + 0.5) / (own.sum() + 1.5)
        if k == 3:  # later rounds would explain away what the classes share
            mean = [table[c, :, 2] - table[c, :, 0] for c in (0, 1)]
            rest = v - ((1 - p)[:, None] * mean[0] + p[:, None] * mean[1])
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = np.clip((rest.T @ rest) / len(v) / np.outer(spread, spread), -1, 1)
            weight = 1 / np.sqrt(np.maximum(np.where(corr > 0.1, corr, 0)[:, :-1].sum(1), 1))
            weight[-1] = 1  # the one voter that speaks where the others are silent
        ratio = np.log(table[1]) - np.log(table[0])
        ratio[:, 2], ratio[:, 0] = np.maximum(ratio[:, 2], 0), np.minimum(ratio[:, 0], 0)  # no voter is worse than chance
        lift = np.einsum("ijk,jk->i", told * weight[None, :, None], ratio)
        p = 1 / (1 + np.exp(-np.clip(lift + np.log(start / (1 - start)), -30, 30)))
    return p, table, corr


def inputs(hit: np.ndarray, words: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """What the classifier sees: whether each lexicon has an entry, whether they have two or five together, and patterns."""
    every = hit.sum(1)[:, None]
    return np.hstack([hit > 0, every > 1, every > 4, (words < 20)[:, None], pattern])


def _least(known: DataFrame, n: int, of: int) -> DataFrame:
    """The n rows of the least hash of doc_id, of the `of` rows of known. Some 3 n of the least hashes are sorted, however many rows there are."""
    key = F.xxhash64("doc_id")
    return known.filter(key <= min(2**63 - 1, 3 * n * 2**64 // max(of, 1) - 2**63)).orderBy(key, "doc_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 2500, other: int = 5000) -> Model | None:
    """A model from rows of docs (doc_id, text) with a label in labels (doc_id, toxic) and crc32(doc_id) mod 4 other than 2.

    At most `toxic` rows of label 1 and `other` of label 0, those of the least
    hash of doc_id. None if there are none of either.
    """
    prepare(docs.sparkSession)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = _least(known.filter("toxic = 1"), toxic, total.get(1, 0)).union(_least(known.filter("toxic = 0"), other, total.get(0, 0)))
    ids = F.broadcast(ids.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("label")))  # at most toxic + other rows
    rows = cut(docs.join(ids, F.col("doc_id") == F.col("_id")).select("label", F.col("text").cast("string").alias("text")))
    had = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(had) < 2:
        return None
    entries, band = lexicons(rows, had[1] / (had[0] + had[1]), (total[0] / had[0]) / (total[1] / had[1]))
    y, hit, words, pattern = _counted(rows, entries, band)
    cuts = np.quantile(pattern, 0.95, axis=0)
    natural = {0: total[0] / (y == 0).sum(), 1: total[1] / (y == 1).sum()}
    share = total[1] / (total[0] + total[1])
    p, _, _ = label_model(votes(hit, words, pattern, cuts), float(y.mean()))
    x, each = inputs(hit, words, pattern), np.where(y == 1, natural[1], natural[0])  # as many as in the labelled rows
    weights, bias = logistic(x, p, each / each.mean(), share)
    return Model(entries, band, cuts, weights, bias)


def _counted(rows: DataFrame, entries: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, hits, words, patterns) of the rows (label, text) of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets, pattern in _chunks(batch, 1):
                hit, words = hits(data, offsets, entries, band)
                out += [row.tobytes() for row in np.hstack([hit, words[:, None], pattern])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["label", "row"])

    found = sorted((r.label, bytes(r.row)) for r in rows.mapInArrow(run, "label int, row binary").collect())
    table, n = np.stack([np.frombuffer(x) for _, x in found]), len(PREFIXES) * BANDS
    return np.array([y for y, _ in found]), table[:, :n], table[:, n], table[:, n + 1 :]


def logistic(x: np.ndarray, p: np.ndarray, each: np.ndarray, share: float, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias that fit the posteriors p, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (q - p)) / len(x) + ridge * np.append(w[:-1], 0)
        curve = (x.T * (each * np.maximum(q * (1 - q), 1e-4))) @ x / len(x) + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, n_hits) of every row of docs (doc_id, text; further columns don't matter).

    The whole text counts. Null and empty texts are scored as texts without
    words. Without a model the score is 0. Equal rows are returned as often as
    they come.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)  # a few thousand entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            p, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets, pattern in _chunks(batch, 1) if m is not None else ():
                hit, words = hits(data, offsets, m.entries, m.voter)
                p[a:b] = 1 / (1 + np.exp(-np.clip(inputs(hit, words, pattern) @ m.weights + m.bias, -30, 30)))
                n[a:b] = hit.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(n)], ["doc_id", "score", "predicted", "n_hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, n_hits long")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """score() of docs by a model fitted on them and labels, with held_out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, fit(docs, labels, **options)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits")
