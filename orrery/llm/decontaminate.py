"""Benchmark decontamination by spaced seeds.

A seed is a hash of a run of tokens in which a fixed mask ignores some places,
so runs that differ there alone still meet. Seeds of the benchmark and of the
documents are joined; a hit fixes a document, an item and the shift between
them, and the tokens around it are compared place by place, so that an overlap
is found across substituted tokens.

Seeds of documents are sieved before the join by a bitmap of the benchmark's
seeds. Its size is fixed (8 MB) whatever the benchmark's: a larger benchmark
lets more through, and the join decides. Only the tokens near hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare
from .text import hashed, joined, mix, slices, spans

#: Places that count in a run of tokens: two blocks of three, next to each other or up to three blocks apart. Of the
#: blocks of 12 tokens of which two are substituted, or of 15 of which three are, two stay whole, so some mask meets.
MASKS = tuple("111" + "000" * k + "111" for k in range(4))
#: Items of fewer tokens than WHOLE use these, which leave out each place once.
SHORT, WHOLE, SPAN = ("001111", "110011", "111100"), 12, len(MASKS[-1])
#: Bits of the bitmap, and tokens kept on either side of a hit.
SLOTS, REACH = 1 << 26, 32
#: Tokens of a benchmark that is sent to all tasks (some 80 bytes each with its seeds); a larger one is met by shuffles.
BROADCAST_TOKENS = 1_000_000
#: Places that are compared at once.
COMPARED = 1 << 20

APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, hash of each token, where each text's tokens start): lower-cased runs of letters and digits."""
    data, offsets = joined(pc.utf8_lower(texts.fill_null("")))
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        start, end = spans(part, APART)
        yield a, b, hashed(part, start, end), np.searchsorted(start, offsets[a : b + 1] - offsets[a])


def masks_of(n: int) -> tuple[str, ...]:
    """Masks of an item of n tokens; below those of SHORT, all its places."""
    return MASKS if n >= WHOLE else SHORT if n >= len(SHORT[0]) else ("1" * n,) if n else ()


def seeds(token: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the places of the mask from each token on, as far as there are enough."""
    m = len(token) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, int("1" + mask, 2), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += token[k : k + m]
    return mix(out)


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, toks, seeds) of benchmark (item_id, text): tokens' hashes, and (hash, pos) of its seeds."""
    prepare(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, toks, found = [], [], []
            for a, b, token, to in tokens(batch.column(1)):
                for i, j in zip(to[:-1], to[1:]):
                    own = token[i:j]
                    n.append(len(own))
                    toks.append(own.astype("<u8").tobytes())
                    found.append([{"hash": int(h), "pos": k} for mask in masks_of(len(own)) for k, h in enumerate(seeds(own, mask).view(np.int64).tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(toks, pa.binary()), pa.array(found, pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))], ["item_id", "n", "toks", "seeds"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, n int, toks binary, seeds array<struct<hash:long,pos:int>>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """SLOTS bits, two set for each hash; gathered as at most SLOTS / 64 words."""
    slot = F.explode(F.array(F.col("hash").bitwiseAND(SLOTS - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(SLOTS - 1))).alias("slot")
    words = hashes.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _in(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def hit_segments(docs: DataFrame, bits: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """(seg, doc_id, first, toks, hits): stretches of documents (doc_id, text) around seeds that the bitmap lets through."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, n = sent.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[dict] = []
            for a, b, token, to in tokens(batch.column(1)):
                size, at, found = np.diff(to), [], []
                left = np.repeat(to[1:], size) - np.arange(len(token))  # tokens of the text from here on
                for mask in masks:
                    h = seeds(token, mask)
                    own = np.flatnonzero(_in(known, h & np.uint64(SLOTS - 1)))
                    own = own[_in(known, h[own] >> np.uint64(32) & np.uint64(SLOTS - 1)) & (left[own] >= len(mask))]
                    at.append(own)
                    found.append(h[own])
                at, found = np.concatenate(at), np.concatenate(found)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                doc = np.searchsorted(to, at, "right") - 1
                new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(at) > 2 * REACH + SPAN)]))
                for i, j in zip(new, [*new[1:], len(at)]):
                    d = int(doc[i])
                    lo, hi = max(int(to[d]), int(at[i]) - REACH), min(int(to[d + 1]), int(at[j - 1]) + SPAN + REACH)
                    n += 1
                    out.append({"seg": (task << 32) + n, "doc_id": ids[a + d], "first": lo - int(to[d]), "toks": token[lo:hi].astype("<u8").tobytes(), "hits": [{"hash": x, "pos": y} for x, y in zip(found[i:j].view(np.int64).tolist(), (at[i:j] - lo).tolist())]})
            if out:
                yield pa.RecordBatch.from_pylist(out, SEGMENT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "seg long, doc_id long, first long, toks binary, hits array<struct<hash:long,pos:int>>")


SEGMENT = pa.schema([("seg", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("toks", pa.binary()), ("hits", pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))])


def overlap(a: np.ndarray, b: np.ndarray, shift: int, least: int, same: float) -> tuple[int, int, int]:
    """(first place in b, places, equal places) of the longest stretch with a[k + shift] against b[k] whose equal share is `same` or more, of those that with most equal places; zeros if it has under `least` places."""
    lo, hi = max(0, -shift), min(len(b), len(a) - shift)
    if hi - lo < max(least, 1):
        return 0, 0, 0
    equal = np.concatenate([[0], np.cumsum(a[lo + shift : hi + shift] == b[lo:hi])])
    share = Fraction(same).limit_denominator(10**6)
    total = share.denominator * equal - share.numerator * np.arange(len(equal))  # a stretch meets the share if it doesn't fall
    most = np.maximum.accumulate(total[::-1])[::-1]
    end = np.searchsorted(-most, -total, "right") - 1  # the last place that isn't lower
    size = end - np.arange(len(end))
    found = np.flatnonzero(size == size.max())
    start = int(found[np.argmax(equal[end[found]] - equal[found])])
    n = int(size[start])
    return (lo + start, n, int(equal[start + n] - equal[start])) if n >= max(least, 1) else (0, 0, 0)


class Known:
    """A benchmark as arrays: the tokens of all items in a row, and their seeds in order of hashes."""

    def __init__(self, rows: list):
        self.ids = [r.item_id for r in rows]
        toks = [np.frombuffer(r.toks, "<u8") for r in rows]
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int64)
        self.toks = np.concatenate([*toks, np.zeros(0, np.uint64)])
        found = [(np.array([s.hash for s in r.seeds], np.int64).view(np.uint64), np.array([s.pos for s in r.seeds], np.int64), i) for i, r in enumerate(rows)]
        item = np.repeat([i for *_, i in found], [len(h) for h, *_ in found]).astype(np.int64)
        hashes, pos = (np.concatenate([*[f[k] for f in found], np.zeros(0, kind)]) for k, kind in ((0, np.uint64), (1, np.int64)))
        order = np.argsort(hashes, kind="stable")
        self.item, self.pos, hashes = item[order], pos[order], hashes[order]
        self.hash, self.first, self.many = np.unique(hashes, return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 16, bool)  # by the first bits of a hash, so that few are looked up
        self.bits[(self.hash >> np.uint64(48)).astype(np.int64)] = True

    def seeds(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of hashes, seed) for each seed of each of the hashes."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(48)).astype(np.int64)]) if len(self.hash) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes[maybe]), len(self.hash) - 1)
        ok = self.hash[at] == hashes[maybe]
        maybe, at = maybe[ok], at[ok]
        n = self.many[at]
        return np.repeat(maybe, n), np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def lines(token: np.ndarray, to: np.ndarray, known: Known, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, shift), each once, of texts (where their tokens start: to) and items that share a seed at that shift."""
    left = np.repeat(to[1:], np.diff(to)) - np.arange(len(token))
    keys = []
    for mask in masks:
        h = seeds(token, mask)
        at, seed = known.seeds(h)
        whole = left[at] >= len(mask)
        at, seed = at[whole], seed[whole]
        doc = np.searchsorted(to, at, "right") - 1
        keys.append(np.stack([doc, known.item[seed], at - to[doc] - known.pos[seed]]))
    found = np.unique(np.concatenate(keys, axis=1), axis=1) if keys else np.zeros((3, 0), np.int64)
    return found[0], found[1], found[2]


def likely(token: np.ndarray, to: np.ndarray, known: Known, doc: np.ndarray, item: np.ndarray, shift: np.ndarray, least: int, same: float) -> np.ndarray:
    """Which (text, item, shift) have as many equal places, wherever they are, as the shortest overlap needs."""
    size, length = np.diff(known.start)[item], np.diff(to)[doc]
    lo, hi = np.maximum(0, -shift), np.minimum(size, length - shift)
    n = np.maximum(hi - lo, 0)
    equal, ends, a = np.zeros(len(doc), np.int64), np.cumsum(n), 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COMPARED, "right")))
        m = n[a:b]
        k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[a:b], m)
        alike = token[np.repeat(to[doc[a:b]] + shift[a:b], m) + k] == known.toks[np.repeat(known.start[item[a:b]], m) + k]
        total = np.concatenate([[0], np.cumsum(alike)])
        to_, from_ = np.cumsum(m), np.cumsum(m) - m
        equal[a:b] = total[to_] - total[from_]
        a = b
    short = size < len(SHORT[0])
    wanted = np.where(short, size, np.ceil(np.minimum(least, size) * same - 1e-9))
    return np.flatnonzero(equal >= wanted)


def better(best: tuple | None, a: np.ndarray, b: np.ndarray, shift: int, first: int, least: int, same: float) -> tuple | None:
    """The longer of best and of the overlap of a and b at this shift, as (equal, -places, -(first of a), -(first of b)); a begins at place `first`."""
    start, n, equal = overlap(a, b, shift, min(least, len(b)), same if len(b) >= len(SHORT[0]) else 1)
    row = (equal, -n, -(first + start + shift), -start)
    return row if n and (best is None or row > best) else best


def verified(docs: DataFrame, known: Known, masks: tuple[str, ...], least: int, same: float) -> DataFrame:
    """The longest overlap of each row of docs (doc_id, text) with each item, found and verified in one task: only overlaps leave it."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for a, _, token, to in tokens(batch.column(1)):
                doc, item, shift = lines(token, to, own, masks)
                keep = likely(token, to, own, doc, item, shift, least, same)
                best: dict[tuple, tuple] = {}
                for d, i, s in zip(doc[keep].tolist(), item[keep].tolist(), shift[keep].tolist()):
                    if row := better(best.get((d, i)), token[to[d] : to[d + 1]], own.toks[own.start[i] : own.start[i + 1]], s, 0, least, same):
                        best[d, i] = row
                out += [(ids[a + d], own.ids[i], -r[2], -r[3], -r[1], r[0]) for (d, i), r in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], list(FOUND))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))


FOUND = ("doc_id", "item_id", "doc_first", "item_first", "n_tokens", "n_same")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 12, same: float = 0.8) -> DataFrame:
    """(doc_id, item_id, doc_first, item_first, n_tokens, n_same): the longest overlap of each pair that has one.

    docs: (doc_id, text), benchmark: (item_id, text); further columns don't
    matter. An overlap has at least `least` tokens in a row of either (or all
    tokens of a shorter item), of which a share `same` or more are equal in
    place. Tokens are lower-cased runs of letters and digits, compared by 64-bit hashes.
    Any overlap of up to 19 tokens is found; of longer ones those whose
    substitutions leave no run of 15 tokens with two whole blocks are missed (none
    of 1,500 random placings at each of 20 to 40 tokens). Items of fewer than six
    tokens have to be there unchanged. Of equally long overlaps of a pair the one
    with the least places counts. Texts of any length are searched whole. Null and empty texts have no overlaps. Null ids are ids like
    others. Rows that share a doc_id (or item_id) are reported once, by their
    longest overlap. Empty tables give an empty result.

    A benchmark of up to BROADCAST_TOKENS tokens is sent to all tasks, which verify
    hits on the spot, so that a phrase of many documents and many items makes no
    rows. A larger one is met by a join of seeds.
    """
    held = cut(items(benchmark))
    known = held.select("item_id", F.explode("seeds").alias("s")).select("item_id", "s.hash", F.col("s.pos").alias("item_pos"))
    short = [r["n"] for r in held.filter(f"n < {WHOLE}").select("n").distinct().collect()]
    masks = MASKS + tuple(sorted({mask for n in short for mask in masks_of(n)}))
    if (held.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_TOKENS:
        return longest(verified(docs, Known(held.filter("n > 0").select("item_id", "toks", "seeds").collect()), masks, least, same))
    segs = cut(hit_segments(docs, bitmap(known), masks))
    hits = segs.select("seg", F.explode("hits").alias("h")).select("seg", "h.hash", "h.pos")
    pairs = hits.join(known, "hash").select("seg", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    pairs = pairs.groupBy("seg", "item_id").agg(F.collect_set("shift").alias("shifts"))  # fewer than the tokens of both
    rows = pairs.join(segs.select("seg", "doc_id", "first", "toks"), "seg").join(held.select(F.col("item_id").alias("_item"), F.col("toks").alias("item_toks")), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, item, shifts, first, a, b in zip(batch.doc_id, batch.item_id, batch["shifts"], batch["first"], batch.toks, batch.item_toks):
                a, b, best = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), None
                for shift in map(int, shifts):
                    best = better(best, a, b, shift, first, least, same)
                if best:
                    out.append((doc, item, -best[2], -best[3], -best[1], best[0]))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "doc_first", "item_first", "n_tokens", "n_same"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    found = rows.select("doc_id", "item_id", "shifts", "first", "toks", "item_toks").mapInPandas(verify, "doc_id long, item_id long, doc_first long, item_first long, n_tokens long, n_same long")
    return longest(found)


def longest(found: DataFrame) -> DataFrame:
    """Of each doc_id and item_id the longest overlap."""
    best = F.max(F.struct("n_same", -F.col("n_tokens"), -F.col("doc_first"), -F.col("item_first"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.col3")).alias("doc_first"), (-F.col("b.col4")).alias("item_first"), (-F.col("b.col2")).alias("n_tokens"), "b.n_same")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of docs without an overlap with the benchmark; see overlaps()."""
    found = overlaps(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias("__found_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__found_id"]), "left_anti")
