"""Removal of repeated passages: winnowed anchors seed matches, windows around them extend these.

A passage of `window` words that occurs in two documents has the same least
k-gram hash among its k-grams in both (k = ANCHOR), so winnowing with that
window leaves both an equal anchor. Documents are joined on anchors; where an
anchor is shared, the match is extended to both sides window by window, and
what equal windows cover in a row is a maximal repeat of at least `window`
words. The first document (by doc_id) that has a window keeps it.

Texts travel as compressed packs of whole documents. Packs ask about their
distinct anchors and windows, not about each occurrence, and are answered for
each of them: a passage that a third of all documents hold is one row for each
pack that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, prepare
from .text import grams, hashed, joined, slices, spans

ANCHOR = 5
#: Bytes of text of a pack, and distinct hashes of a task that compares them.
PACK, ASKED = 4 << 20, 3_000_000
#: Bytes of text (or one longer word) that are hashed at once, and bytes of texts (or one longer text) in a batch of results.
SLICE, SENT = 1 << 18, 1 << 20


def packs(docs: DataFrame) -> DataFrame:
    """(pack, n_bytes, data): documents (doc_id, text) in compressed packs of about PACK bytes or one longer document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal n
            rows, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows)
            n += 1
            data = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["pack", "n_bytes", "data"])

        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(1).fill_null("").cast(pa.binary()).to_pandas().map(len), np.int64)) if batch.num_rows else []
            a = 0
            while a < batch.num_rows:
                base = ends[a - 1] if a else 0
                b = min(batch.num_rows, max(a + 1, int(np.searchsorted(ends, base + PACK - size, "right"))))
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1] - base)
                a = b
                if size >= PACK or a < batch.num_rows:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "pack long, n_bytes long, data binary")


class Pack:
    """A pack's documents as arrays over one buffer: words, their documents and their hashes."""

    def __init__(self, data: bytes | pa.Buffer, window: int):
        import zstandard

        rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()
        self.ids = [x.as_py() for x in rows.column("doc_id")]
        self.window = window
        texts = rows.column("text").combine_chunks() if isinstance(rows.column("text"), pa.ChunkedArray) else rows.column("text")
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        self.data, self.offsets = joined(texts)
        self.start, self.end = spans(self.data)
        self.first = np.searchsorted(self.start, self.offsets)  # first word of each document, and the end
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))
        self.words = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(self.start):
            base = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, base + SLICE, "right")))
            self.words[a:b] = hashed(self.data[base : self.end[b - 1]], self.start[a:b] - base, self.end[a:b] - base)
            a = b

    def order(self) -> np.ndarray:
        """doc_id of each document, a null one after all others."""
        return np.array([np.iinfo(np.int64).max if x is None else x for x in self.ids], np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor of each window, the word that it starts at): the least k-gram hash in it."""
        k = min(ANCHOR, self.window)
        gram, _ = grams(self.words, self.doc, k)
        m = len(self.words) - self.window + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        least = gram[:m].copy()
        for i in range(1, self.window - k + 1):
            np.minimum(least, gram[i : i + m], out=least)
        at = np.flatnonzero(self.doc[:m] == self.doc[self.window - 1 :])
        return least[at], at

    def windows(self) -> np.ndarray:
        """Hash of the window that starts at each word."""
        return grams(self.words, self.doc, self.window)[0]


def least_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, least value, greatest value)."""
    if not len(keys):
        return keys, values, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)


#: Types of keys and values as sent. Of an anchor the low half goes: with the part, which the high half names, a
#: part of ASKED anchors confuses one in a thousand with another, and windows decide.
Kinds = tuple[type, type]
ANCHORS, WINDOWS = (np.uint32, np.int8), (np.uint64, np.int64)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _short(keys: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """What is left of anchors that were sent as ANCHORS."""
    return keys.astype(np.uint32).astype(np.uint64) | (np.asarray(part, np.uint64) << np.uint64(32))


SENT_AS = "part int, pack long, keys binary, vals binary"
_SENT_AS = pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])


def _split(pack: int, parts: int, keys: np.ndarray, values: np.ndarray, kinds: Kinds) -> pa.RecordBatch:
    """A row for each part of the hash range that keys (in order) fall in."""
    part = _part(keys, parts)
    keys, values = keys.astype(kinds[0]), values.astype(kinds[1])
    to = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
    own = np.flatnonzero(np.diff(to))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((own, [pack] * len(own), [keys[to[p] : to[p + 1]].tobytes() for p in own], [values[to[p] : to[p + 1]].tobytes() for p in own]), _SENT_AS)], schema=_SENT_AS)


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _gathered(group: pa.Table, kinds: Kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = [_array(x, kinds[0]) for x in group["keys"]]
    row = np.arange(len(keys), dtype=np.uint16 if len(keys) < 1 << 16 else np.int64)  # small ones are sorted fastest
    return np.concatenate(keys), np.concatenate([_array(x, kinds[1]) for x in group["vals"]]), np.repeat(row, [len(x) for x in keys])


def _answered(questions: DataFrame, kinds: Kinds) -> DataFrame:
    """For each pack, of its keys those that other packs have or that several of its own documents have, with the least value of all packs."""

    def meet(group: pa.Table) -> pa.Table:
        keys, values, pack = _gathered(group, kinds)
        order = np.argsort(keys)
        keys, values, pack = keys[order], values[order], pack[order]
        del order
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(values, at)
        shared = np.diff(np.append(at, len(keys))) > 1
        if (values < 0).any():  # the pack itself has it in several documents
            shared |= least < 0
        own = np.flatnonzero(np.repeat(shared, np.diff(np.append(at, len(keys)))))
        own = own[np.argsort(pack[own], kind="stable")]
        least = least[(np.cumsum(new) - 1)[own]]
        to = np.searchsorted(pack[own], np.arange(len(group) + 1))
        some = np.flatnonzero(np.diff(to))
        keys = keys[own]
        return pa.table([pa.array([group["part"][0].as_py()] * len(some), pa.int32()), group["pack"].take(pa.array(some)), pa.array([keys[to[i] : to[i + 1]].tobytes() for i in some], pa.binary()), pa.array([least[to[i] : to[i + 1]].tobytes() for i in some], pa.binary())], schema=_SENT_AS)

    answers = questions.groupBy("part").applyInArrow(meet, SENT_AS)
    return answers.groupBy("pack").agg(F.collect_list(F.struct("part", "keys", "vals")).alias("told"))  # at most as many as there are parts


def _told(told: pa.Scalar, kinds: Kinds) -> tuple[np.ndarray, np.ndarray]:
    """All keys that a pack was answered about, in order, and their values."""
    parts, keys, values = (told.values.field(k) for k in ("part", "keys", "vals")) if told.is_valid else ([], [], [])
    keys = [_array(k, kinds[0]) if kinds == WINDOWS else _short(_array(k, kinds[0]), part.as_py()) for k, part in zip(keys, parts)]
    keys = np.concatenate(keys or [np.zeros(0, np.uint64)])
    values = np.concatenate([_array(x, kinds[1]) for x in values] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return keys[order], values[order]


def _has(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each of sought is among the ordered keys, where)."""
    if not len(keys):
        return np.zeros(len(sought), bool), np.zeros(len(sought), np.int64)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return keys[at] == sought, at


def removed(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept_text) of every row of docs (doc_id, text; further columns don't matter).

    A word is removed if a run of `window` words that covers it also starts in a
    document of a smaller doc_id. Words are runs without ASCII white space. spans:
    (first word, words) of each maximal repeat that was removed. kept_text is the
    rest, joined by spaces. A null text has no words; texts shorter than a window
    stay whole. A null doc_id counts as larger than all others. Rows that share a
    doc_id are one document to each other: they don't remove each other's words.
    Equal rows are returned as often as they come; an empty table gives an empty
    result. Windows are compared by 64-bit hashes.
    """
    spark = prepare(docs.sparkSession)
    n = partitions(spark)
    held = cut(packs(docs).repartition(n, "pack"))  # dealt by pack, so that the joins below needn't
    size = held.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(max(n, size // 5 // 5 // ASKED * 2 + 1))  # about a fifth of the words are anchors

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data in _values(batches):
            p = Pack(data.as_buffer(), window)
            anchor, at = p.anchors()
            keys, low, high = least_of(anchor, p.order()[p.doc[at]])
            yield _split(key.as_py(), parts, keys, np.where(low != high, -1, 0), ANCHORS)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data, told in _values(batches):
            p = Pack(data.as_buffer(), window)
            anchor, at = p.anchors()
            at = at[_has(_told(told, ANCHORS)[0], _short(anchor, _part(anchor, parts)))[0]]
            keys, low, _ = least_of(p.windows()[at], p.order()[p.doc[at]])
            yield _split(key.as_py(), parts, keys, low, WINDOWS)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, told in _values(batches):
            p = Pack(data.as_buffer(), window)
            _, at = p.anchors()
            own, ids = p.windows()[at], p.order()
            keys, low, _ = least_of(own, ids[p.doc[at]])
            known, least = _told(told, WINDOWS)
            found, place = _has(known, keys)
            low = np.where(found, np.minimum(low, least[place]) if len(least) else low, low)
            at = at[low[np.searchsorted(keys, own)] < ids[p.doc[at]]]
            del own, keys, low, known, least, found, place
            cover = np.zeros(len(p.words) + 1, np.int32)
            cover[at] += 1
            cover[at + window] -= 1
            gone = np.cumsum(cover, dtype=np.int32)[:-1] > 0
            del cover, at
            yield from _rows(p, gone)

    anchors = _answered(held.select("pack", "data").mapInArrow(ask_anchors, SENT_AS), ANCHORS)
    windows = _answered(held.join(anchors, "pack", "left").select("pack", "data", "told").mapInArrow(ask_windows, SENT_AS), WINDOWS)
    return held.join(windows, "pack", "left").select("data", "told").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,words:long>>, kept_text string")


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, ...]]:
    """The rows of all batches, one at a time; what one held is given back before the next."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i] for c in batch.columns)
            pa.default_memory_pool().release_unused()


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), ("kept_text", pa.string())])


def _rows(p: Pack, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The results of a pack's documents, some SENT bytes of text at a time."""
    mask = np.zeros(len(p.data) + 1, np.int8)
    mask[p.start[~gone]] += 1
    mask[p.end[~gone] + 1] -= 1  # with the space after it
    keep = np.cumsum(mask, dtype=np.int8)[:-1] > 0
    del mask
    line = p.data.copy()
    line[p.end[~gone]] = 32
    size = np.add.reduceat(keep, p.offsets[:-1], dtype=np.int64) if len(p.ids) else np.zeros(0, np.int64)
    line, to = line[keep], np.concatenate([[0], np.cumsum(size)])
    del keep
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    cuts = np.diff(p.doc) != 0
    begins, ends = edge == 1, edge == -1
    begins[1:-1] |= cuts & gone[1:] & gone[:-1]
    ends[1:-1] |= cuts & gone[1:] & gone[:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    owner = np.searchsorted(p.first, begins, "right") - 1
    runs = np.searchsorted(owner, np.arange(len(p.ids) + 1))  # first run of each document, and the end
    span = pa.StructArray.from_arrays([pa.array(begins - p.first[owner]), pa.array(ends - begins)], ["first", "words"])
    total = np.concatenate([[0], np.cumsum(gone)])
    n_removed = total[p.first[1:]] - total[p.first[:-1]]
    for a, b in slices(p.offsets, SENT):
        kept = [line[x : max(x, y - 1)].tobytes() for x, y in zip(to[a:b], to[a + 1 : b + 1])]
        lists = pa.ListArray.from_arrays(pa.array((runs[a : b + 1] - runs[a]).astype(np.int32)), span.slice(int(runs[a]), int(runs[b] - runs[a])))
        columns = [pa.array(p.ids[a:b], pa.int64()), pa.array(np.diff(p.first[a : b + 1])), pa.array(n_removed[a:b]), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), lists.cast(_ROWS.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)
