"""Token ids as patched frame-of-reference blocks.

Texts are dealt by ranges of doc_id, encoded, and written as segments of whole
documents in ascending order. A segment is, little-endian:

    4s   magic b"PFR1"
    u32  documents d, u64 ids n, u32 blocks b
    i64  doc_id of each document
    u8   1 if the doc_id is null, for each document
    u32  ids of each document
    u64  index: where each block starts, from the first block on
    b blocks of 128 ids (the last is filled up with its minimum):
        u32 minimum, u8 width, u8 exceptions e,
        16 * width bytes: id - minimum of each id, its low `width` bits,
        e * u8 places and e * u32 id - minimum of those that need more bits

The width of a block is the number of bits that a chosen share of its ids need.
Segments are kept in the binary column of a Parquet table, so any store that
Spark can write holds them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, shared_path

BLOCK = 128
SEGMENT = "shard long, segment long, shard_start long, n_docs long, n_tokens long, data binary"
_HEAD = struct.Struct("<4sIQI")
#: Letters whose case and composition are beyond doubt, then marks that aren't letters or digits.
PLAIN = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!-/:-@\[-`{-~]*)$"


def pack(values: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blocks, where each starts) for unsigned 32-bit values."""
    n = -len(values) // BLOCK * -1
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    full = np.concatenate([values, np.repeat(values[(n - 1) * BLOCK :].min(), n * BLOCK - len(values))]).astype(np.uint32).reshape(n, BLOCK)
    least = full.min(1)
    rest = full - least[:, None]
    need = np.frexp(rest.astype(np.float64))[1]  # bits of each
    width = np.sort(need, 1)[:, max(0, int(np.ceil(share * BLOCK)) - 1)]
    over = need > width[:, None]
    extra = over.sum(1)
    size = 6 + 16 * width + 5 * extra
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = least.view(np.uint8).reshape(n, 4)
    out[start + 4], out[start + 5] = width, extra
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(rest[own].view(np.uint8).reshape(len(own), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        out[(start[own] + 6)[:, None] + np.arange(16 * w)] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
    if extra.any():
        row, place = np.nonzero(over)
        k = np.arange(len(row)) - (np.cumsum(extra) - extra)[row]
        at = (start + 6 + 16 * width)[row]
        out[at + k] = place
        out[(at + extra[row] + 4 * k)[:, None] + np.arange(4)] = rest[row, place].copy().view(np.uint8).reshape(-1, 4)
    return out, start


def unpack(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The values of the blocks that start there, BLOCK for each."""
    n = len(start)
    out = np.zeros((n, BLOCK), np.uint32)
    if not n:
        return out.ravel()
    least = data[start[:, None] + np.arange(4)].copy().view(np.uint32)
    width, extra = data[start + 4].astype(np.int64), data[start + 5].astype(np.int64)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = np.zeros((len(own), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(data[(start[own] + 6)[:, None] + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(own), BLOCK, w)
        out[own] = np.packbits(bits, axis=2, bitorder="little").view(np.uint32)[:, :, 0]
    if extra.any():
        row = np.repeat(np.arange(n), extra)
        k = np.arange(len(row)) - (np.cumsum(extra) - extra)[row]
        at = (start + 6 + 16 * width)[row]
        out[row, data[at + k]] = data[(at + extra[row] + 4 * k)[:, None] + np.arange(4)].copy().view(np.uint32)[:, 0]
    return (out + least).ravel()


def segment(ids: list[int | None], counts: np.ndarray, values: np.ndarray, share: float = 0.9) -> bytes:
    blocks, start = pack(values, share)
    null = np.array([x is None for x in ids], np.uint8)
    return b"".join([_HEAD.pack(b"PFR1", len(ids), len(values), len(start)), np.array([x or 0 for x in ids], "<i8").tobytes(), null.tobytes(), np.asarray(counts, "<u4").tobytes(), start.astype("<u8").tobytes(), blocks.tobytes()])


class Segment:
    """A segment's documents; ids are decoded when they are asked for."""

    def __init__(self, data: bytes):
        magic, docs, self.n, blocks = _HEAD.unpack_from(data)
        if magic != b"PFR1":
            raise ValueError("not a segment")
        at = _HEAD.size
        ids = np.frombuffer(data, "<i8", docs, at)
        null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.counts = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
        self.index = np.frombuffer(data, "<u8", blocks, at + 13 * docs).astype(np.int64)
        self.blocks = np.frombuffer(data, np.uint8, offset=at + 13 * docs + 8 * blocks)

    def read(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids a .. b - 1, from the blocks that hold them alone."""
        b = self.n if b is None else b
        first = a // BLOCK
        return unpack(self.blocks, self.index[first : -(-b // BLOCK)])[a - first * BLOCK : b - first * BLOCK]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def laid(pool: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words that `which` names, one after the other, and where each starts, with the end)."""
    n = sizes[which]
    to = np.concatenate([[0], np.cumsum(n)])
    return pool[np.repeat((np.cumsum(sizes) - sizes)[which] - to[:-1], n) + np.arange(to[-1])], to


class Pieces:
    """Pieces of text that were met, in one pool of ids; of more than `most`, those met least often are forgotten."""

    def __init__(self, ask: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.ask, self.most = ask, most
        self.at: dict[str, int] = {}  # in the order of the pool
        self.ids, self.sizes, self.met = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        if len(self.at) > self.most:
            keep = np.zeros(len(self.at), bool)
            keep[np.argsort(-self.met, kind="stable")[: self.most * 3 // 4]] = True
            self.at = {w: k for k, w in enumerate(compress(self.at, keep.tolist()))}
            self.ids, self.sizes, self.met = self.ids[np.repeat(keep, self.sizes)], self.sizes[keep], self.met[keep] // 2

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, which differ, and their numbers)."""
        self.trim()
        listed = words.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.at.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(at < 0)
        if len(new):
            parts = [listed[k] for k in new.tolist()]
            ids, sizes = self.ask(parts)
            first = len(self.at)
            self.at.update(zip(parts, range(first, first + len(parts))))
            at[new] = np.arange(first, first + len(parts))
            self.ids, self.sizes, self.met = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes]), np.concatenate([self.met, np.zeros(len(parts), np.int64)])
        self.met[at] += 1
        return laid(self.ids, self.sizes, at)[0], self.sizes[at]


@lru_cache(2)
def encoder(path: str, most: int = 300_000):
    """A function from texts to all their ids and how many each text has; a worker loads it once.

    This kind of tokenizer never joins what a space or line break parts, so it
    is asked once for each distinct piece; nor does it join letters and marks,
    and it ignores case, so pieces of plain letters and closing marks share
    their letters' ids. Distinct runs of letters are encoded many at a time and
    told apart by the tokens that end words. `most` bounds the pieces remembered.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    ends = np.zeros(model.get_vocab_size(), bool)
    ends[[i for t, i in model.get_vocab().items() if t.endswith("</w>")]] = True

    def alone(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in model.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found], np.int64)

    def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for k in range(0, len(words), 500):
            part = words[k : k + 500]
            ids = np.array(model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            to = np.flatnonzero(ends[ids]) + 1
            out.append((ids, np.diff(to, prepend=0)) if len(to) == len(part) and to[-1] == len(ids) else alone(part))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    known, letters = Pieces(alone, most), Pieces(together, most)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        match = pc.extract_regex(words, PLAIN)
        plain = match.is_valid()
        shape = match.filter(plain)
        letter, mark = (x.dictionary_encode() for x in (pc.utf8_lower(shape.field("a")), shape.field("b")))
        told = [letters.of(letter.dictionary), known.of(mark.dictionary), known.of(words.filter(pc.invert(plain)))]
        pool, sizes = np.concatenate([x for x, _ in told]), np.concatenate([n for _, n in told])
        first, second = len(letter.dictionary), len(letter.dictionary) + len(mark.dictionary)
        two = np.full((len(words), 2), len(sizes))  # each word's letters and marks, or itself and nothing
        at = plain.to_numpy(zero_copy_only=False)
        two[at, 0], two[at, 1] = letter.indices.to_numpy(), first + mark.indices.to_numpy()
        two[~at, 0] = second + np.arange(len(words) - int(at.sum()))
        pool, to = laid(pool, np.append(sizes, 0), two.ravel())
        ids, to = laid(pool, np.diff(to[::2]), coded.indices.to_numpy())
        return ids, np.diff(to[parts.offsets.to_numpy() - parts.offsets[0].as_py()])

    return encode


def gathered(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about that many bytes, as distinct pieces are fewer in more text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


def segments(docs: DataFrame, tokenizer: str | None = None, end: int = 1, share: float = 0.9, most: int = 1 << 19) -> DataFrame:
    """Segments (SEGMENT) of docs (doc_id, text) in ascending order of doc_id, of about `most` ids or one longer document."""
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, k, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        for group in gathered(batches):
            doc_ids = group.column(0).to_pylist()
            ids, counts = encode(group.column(1).fill_null(""))
            ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
            to = np.concatenate([[0], np.cumsum(counts)])
            a = 0
            while a < len(counts):
                b = min(len(counts), max(a + 1, int(np.searchsorted(to, to[a] + most, "right")) - 1))
                row = [shard, k, before, b - a, int(to[b] - to[a]), segment(doc_ids[a:b], counts[a:b], ids[to[a] : to[b]], share)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 5 + [pa.binary()])], ["shard", "segment", "shard_start", "n_docs", "n_tokens", "data"])
                a, k, before = b, k + 1, before + row[4]

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id")
    return dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, SEGMENT)


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the ids of docs (doc_id, text) under path.

    A null text counts as empty; every document ends with the id `end`, so an
    empty one has that id alone. A null doc_id comes first. Repeated doc_ids keep
    one entry each, in the order of a hash of their texts. Further columns don't
    matter. An empty table gives a table without segments.
    """
    segments(docs, **options).write.parquet(path)


def starts(written: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before it; a row for each partition that was written."""
    total = written.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return total.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document under path, decoded from the segments."""
    written = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = Segment(data)
                values = found.read().astype("<u4").tobytes()
                to = np.cumsum(found.counts)
                sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(to - found.counts, to)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(sums), pa.int64()), pa.array(found.doc_ids, pa.int64()), pa.array(before + to - found.counts), pa.array(found.counts), pa.array(sums, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = written.select("shard", "shard_start", "data").mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    # a row of two longs for each partition of the write: well under 100 MB for a million of them
    return rows.join(F.broadcast(starts(written)), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write docs into the shared folder and read them back; see write() and read()."""
    spark = prepare(docs.sparkSession)
    write(docs, path := shared_path(spark), **options)
    return read(spark, path)
