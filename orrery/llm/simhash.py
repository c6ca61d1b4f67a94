"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2 r bits exactly if some value lies within r
bits of both. So every distinct fingerprint emits all variants within r bits
(r = 2: 2,081 of them), equal variants meet, and the fingerprints that meet are
verified. A variant's first bits name the task it is shuffled to; a row of the
shuffle is a fingerprint and such a prefix, and stands for all its variants that
begin with the prefix, which the task expands. That moves a few dozen rows for
each fingerprint in place of 2,081. Prefixes grow with the number of
fingerprints. Where one is crowded they are lengthened and counted again, up to
the whole variant if need be, so a group's work is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, looked_up, prepare
from .components import components

#: A prefix is lengthened while more variants begin with it than so many fingerprints have.
CROWD = 1500


def fingerprint(text: bytes, words: int = 4) -> int:
    """64 bits, each 1 if set in over half of the XXH64 (seed 42) of all word shingles; 0 without words."""
    import xxhash

    parts = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, 42)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts, ends = (ends - sizes)[: 1 - words].tolist(), ends[words - 1 :].tolist()
    found = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((x or "").encode(), words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def masks(bits: int, most: int) -> np.ndarray:
    """All values of so many low bits with at most `most` of them set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def reached(fps: np.ndarray, first: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): the values that bits first .. first + bits take in a fingerprint's variants."""
    own = (fps >> np.uint64(64 - first - bits)) & np.uint64((1 << bits) - 1)
    m = masks(bits, radius)
    return np.repeat(np.arange(len(fps)), len(m)), (own[:, None] ^ m).ravel()


def links(fps: np.ndarray, cell: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one cell, each with the least of those that it is linked to through variants that begin with the cell's bits."""
    fps = np.unique(fps)
    low = 64 - bits
    spent = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(cell)).astype(np.int64)
    rows, values = [], []
    for k in range(radius + 1):
        own = np.flatnonzero(spent == k)
        if len(own):
            m = masks(low, radius - k)
            rows.append(np.repeat(own.astype(np.int32), len(m)))
            values.append(((fps[own] & np.uint64((1 << low) - 1))[:, None] ^ m).ravel())
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(values)
    values = values[order]
    met = np.flatnonzero(values[1:] == values[:-1])
    one, two = rows[order[met]].astype(np.int64), rows[order[met + 1]].astype(np.int64)
    del rows, values, order, met
    pairs = np.unique(np.minimum(one, two) * len(fps) + np.maximum(one, two))
    a, b = pairs // len(fps), pairs % len(fps)
    close = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius  # verified
    a, b, root = a[close], b[close], np.arange(len(fps))
    while True:  # hook each end to the other's root, then shorten the paths
        least = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        if (was == root).all():
            break
    tied = np.flatnonzero(root != np.arange(len(fps)))
    return fps[tied], fps[root[tied]]


def cells(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(bits, cell, fp) of fps: distinct (fp). Each variant of a fingerprint begins with just one of its cells, and those of one cell are CROWD balls of variants at most, or, where all 64 bits are the cell, the fingerprints around one value."""
    n = fps.count()
    bits = max(6, int(np.ceil(np.log2(max(n, 1) / 600))))
    most = CROWD * len(masks(64, radius))

    def first(bits: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                fps = batch.fp.to_numpy(np.int64).view(np.uint64)
                row, cell = reached(fps, 0, bits, radius)
                yield pd.DataFrame({"cell": cell.view(np.int64), "fp": fps[row].view(np.int64)})

        return run

    def light(crowded: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[~np.isin(batch.cell.to_numpy(np.int64), crowded)]

        return run

    def longer(crowded: np.ndarray, bits: int, more: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch[np.isin(batch.cell.to_numpy(np.int64), crowded)]
                fps, cell = (batch[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "cell"))
                left = radius - np.bitwise_count((fps >> np.uint64(64 - bits)) ^ cell).astype(np.int64)
                for k in np.unique(left):
                    at, second = reached(fps[left == k], bits, more, int(k))
                    yield pd.DataFrame({"cell": ((cell[left == k][at] << np.uint64(more)) | second).view(np.int64), "fp": fps[left == k][at].view(np.int64)})

        return run

    rows, out = fps.mapInPandas(first(bits), "cell long, fp long"), []
    while True:
        variants = F.array(*(F.lit(len(masks(64 - bits, k))) for k in range(radius, -1, -1)))  # by the bits that the cell has spent
        spent = F.bit_count(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("cell")))
        # at most one cell for each CROWD fingerprints
        crowded = [] if bits == 64 else [r[0] for r in rows.groupBy("cell").agg(F.sum(F.element_at(variants, spent + 1)).alias("n")).filter(F.col("n") > most).select("cell").collect()]
        some = np.array(sorted(crowded), np.int64)
        out.append((rows.mapInPandas(light(some), "cell long, fp long") if crowded else rows).select(F.lit(bits).alias("bits"), "cell", "fp"))
        if not crowded:
            break
        more = min(64 - bits, 12)
        rows = cut(rows.mapInPandas(longer(some, bits, more), "cell long, fp long"))
        bits += more
    return reduce(DataFrame.union, out)


def linked(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) of fingerprints; its connected components are those of all pairs within 2 * radius bits. fps: distinct (fp)."""

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = links(group.fp.to_numpy(np.int64).view(np.uint64), int(key[1]) & (1 << 64) - 1, int(key[0]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells(fps, radius).groupBy("bits", "cell").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text; further columns don't matter).

    Fingerprints of at most 2 * radius differing bits are linked; component_id is
    the smallest doc_id that links reach. Null and empty texts and texts without
    words have fingerprint zero and are linked like any other. A null doc_id gets
    a row of its own with the component of its fingerprint. Equal rows are
    returned as often as they come. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, words))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(linked(groups.select("fp"), radius))
    ids = cut(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    tied = ids.filter("root IS NOT NULL")
    least = cut(tied.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m")))
    alone = ids.filter("root IS NULL").select("fp", F.col("first").alias("component_id"), "n")
    known = alone.union(looked_up(tied, least, "root", "m").select("fp", "component_id", "n"))
    return looked_up(fps, cut(known), "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 4, radius: int = 2) -> DataFrame:
    """Rows of docs whose doc_id is the smallest of its component; of rows that share that id, all stay, and rows with a null id stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), words, radius).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["__kept_id"], "left").filter("__kept_id IS NOT NULL OR doc_id IS NULL").drop("__kept_id")
