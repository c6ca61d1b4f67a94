"""Audit of how a language's sources differ in their words.

A table of 256 entries says which bytes belong to terms, so the bounds of all
terms of many documents are found at once over their joined UTF-8 bytes. Terms
are grouped by XXH64, and each is compared byte by byte with the first of its
group. A task sends one row for each term and (lang, source) of a chunk of text,
with its occurrences and documents. Terms that enough documents have are dealt
into shards of a bounded number of counts; in each the counts are sparse rows,
term by source, and sums of differences over them are additive. All arithmetic is
in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored
from .text import joined, spans

#: Bytes of terms: letters A-Z and a-z, and all bytes of other than ASCII characters. In terms A-Z are in lower case.
PART = np.zeros(256, bool)
PART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
#: Bytes of text that are counted at once, and counts that a task compares.
CHUNK, COUNTS = 8 << 20, 400_000
#: Longer terms are compared one by one.
LONG = 64
digest = xxhash.xxh64_intdigest


def differs(data: np.ndarray, start: np.ndarray, end: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether data[start:end] has other bytes than slice `to` has, for each slice."""
    size = end - start
    out = size != size[to]
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    mask = np.concatenate([(np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1), [np.uint64(0xFFFFFFFFFFFFFFFF)]])
    rest = np.flatnonzero(~out & (size <= LONG))
    for k in range(0, LONG, 8):
        rest = rest[size[rest] > k]
        m = mask[np.minimum(size[rest] - k, 8)]
        out[rest] |= (words[start[rest] + k] & m) != (words[start[to[rest]] + k] & m)
    for i in np.flatnonzero(~out & (size > LONG)).tolist():
        out[i] = not np.array_equal(data[start[i] : end[i]], data[start[to[i]] : end[to[i]]])
    return out


def grouped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the term, for each slice of data; a slice of each term)."""
    view = data.tobytes()
    h = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    odd, known, more = np.flatnonzero(differs(data, start, end, first[which])), {}, []
    for i in odd.tolist():  # one hash, other bytes
        term = view[start[i] : end[i]]
        if term not in known:
            known[term] = len(first) + len(known)
            more.append(i)
        which[i] = known[term]
    return which, np.concatenate([first, np.array(more, np.int64)])


def tally(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of texts; group: of each text, in ascending order."""
    data, offsets = joined(texts)
    data = FOLD[data]
    start, end = spans(data, ~PART)
    which, first = grouped(data, start, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    order = np.argsort(which, kind="stable")
    which, doc = which[order], doc[order]
    term, own = np.diff(which, prepend=-1) != 0, group[doc]
    rows = np.flatnonzero(term | (np.diff(own, prepend=-1) != 0))
    view = data.tobytes()
    terms = pa.array([view[start[i] : end[i]] for i in first.tolist()], pa.binary()).cast(pa.string())
    docs = np.add.reduceat((term | (np.diff(doc, prepend=-1) != 0)).astype(np.int64), rows) if len(rows) else rows
    return own[rows], terms.take(pa.array(which[rows])), np.diff(np.append(rows, len(which))), docs


def pieces(text: pa.Scalar) -> Iterator[bytes]:
    """A long text in pieces of CHUNK bytes or more, none of which ends within a term."""
    data = np.frombuffer(text.as_buffer(), np.uint8)
    a = 0
    while a < len(data):
        b = min(a + CHUNK, len(data))
        while b < len(data) and PART[data[b]]:
            apart = np.flatnonzero(~PART[data[b : b + CHUNK]])
            b += int(apart[0]) if len(apart) else min(CHUNK, len(data) - b)
        yield data[a:b].tobytes()
        a = b


def terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term and documents with it in some of the rows of docs (text, lang, source)."""
    prepare(docs.sparkSession)

    def told(langs: pa.Array, sources: pa.Array, found: tuple) -> pa.RecordBatch:
        group, term, n, with_it = found
        at = pa.array(group)
        return pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term, pa.array(n, pa.int64()), pa.array(with_it, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def count(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).to_pandas(types_mapper={pa.string(): pd.ArrowDtype(pa.string())}.get)
        rows["at"] = np.arange(len(rows))
        key = rows.groupby(["lang", "source"], sort=False).ngroup().to_numpy()
        order = np.argsort(key, kind="stable")
        texts = pa.array(rows["text"].array).take(pa.array(order))
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        first = np.unique(key, return_index=True)[1]
        langs, sources = (pa.array(rows[c].to_numpy(object)[first], pa.string()) for c in ("lang", "source"))
        yield told(langs, sources, tally(texts, key[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            bytes_ = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(bytes_ > CHUNK).tolist():  # counted piece by piece, and as one document
                found = [tally(pa.array([x]), np.zeros(1, np.int64)) for x in pieces(batch.column(2)[i])]
                rows = pa.table({"term": pa.chunked_array([x[1] for x in found]), "n": np.concatenate([x[2] for x in found])}).group_by("term").aggregate([("n", "sum")])
                own = np.zeros(len(rows), np.int64)
                yield told(batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), (own, rows["term"].combine_chunks(), rows["n_sum"].to_numpy(), own + 1))
            if (bytes_ > CHUNK).any():
                batch = batch.filter(pa.array(bytes_ <= CHUNK))
            if batch.num_rows:
                held.append(batch)
                size += int(bytes_[bytes_ <= CHUNK].sum())
            if size >= CHUNK:
                yield from count(held)
                held, size = [], 0
        if held:
            yield from count(held)

    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return own.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept(found: DataFrame, documents: int) -> DataFrame:
    """(lang, source, term, n, total, first) of found (terms()): terms that so many documents of the lang have, total over its sources; first: in one row of a term."""
    each = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = Window.partitionBy("lang", "term")  # as many as the lang has sources
    each = each.select("lang", "source", "term", "n", F.sum("docs").over(rows).alias("docs"), F.sum("n").over(rows).alias("total"), (F.min("source").over(rows) == F.col("source")).alias("first"))
    return each.filter(F.col("docs") >= documents).drop("docs")


def scaled(count: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 (count + 5) / n), by long division, for counts up to 9 * 10**15."""
    rest, out = np.asarray(count, np.int64) + 5, np.int64(0)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // n, rest % n
    return out + 1


def differences(term: np.ndarray, col: np.ndarray, p: np.ndarray, zero: np.ndarray, pairs: int = 1 << 20) -> np.ndarray:
    """The sum of abs(p - q) over all terms for each two columns: sparse rows (term, col), term by term; a column has p `zero` where it has no count."""
    n, begin = len(zero), np.flatnonzero(np.diff(term, prepend=-1) != 0)
    size = np.diff(np.append(begin, len(term)))
    alone, own = np.zeros((n, n), np.int64), np.bincount(col, minlength=n)  # column a against the zero of b, over all of a
    by_col = np.argsort(col, kind="stable")
    for a, values in enumerate(np.split(p[by_col], np.cumsum(own)[:-1])):
        values = np.sort(values)
        total = np.concatenate([[0], np.cumsum(values)])
        k = np.searchsorted(values, zero)
        alone[a] = total[-1] - 2 * total[k] + zero * (2 * k - len(values))
    both, less, common = (np.zeros(n * n, np.int64) for _ in range(3))
    width = size.astype(np.int64) ** 2
    ends = np.cumsum(width)
    lo = 0
    while lo < len(begin):  # rows of some million pairs at once
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + pairs, "right")))
        w, s, b = width[lo:hi], size[lo:hi], begin[lo:hi]
        k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        s, b = np.repeat(s, w), np.repeat(b, w)
        x, y = b + k // s, b + k % s
        code = col[x] * n + col[y]
        order = np.argsort(code, kind="stable")
        code = code[order]
        at = np.flatnonzero(np.diff(code, prepend=-1) != 0)
        cells = code[at]
        both[cells] += np.add.reduceat(np.abs(p[x] - p[y])[order], at)
        less[cells] += np.add.reduceat(np.abs(p[x] - zero[col[y]])[order], at)
        common[cells] += np.diff(np.append(at, len(code)))
        lo = hi
    alone, both, common = alone - less.reshape(n, n), both.reshape(n, n), common.reshape(n, n)
    neither = len(begin) - own[:, None] - own[None, :] + common
    return alone + alone.T + both + neither * np.abs(zero[:, None] - zero[None, :])


def shares(key: tuple, rows: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    """One shard's part of the sums for pairs, and its first terms of each source."""
    lang, shard = key
    groups = groups.sort_values("source", ignore_index=True)
    names = groups["source"].to_numpy(object)
    out = {"lang": lang, "source": [], "part": [], "item": [], "value": []}

    def add(part: str, a: np.ndarray, item: np.ndarray, value: np.ndarray) -> None:
        for k, v in (("source", names[a]), ("part", [part] * len(a)), ("item", item), ("value", value)):
            out[k].extend(v)

    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    if len(rows):
        words, term = np.unique(rows["term"].to_numpy(object), return_inverse=True)  # by code point, which is the order of UTF-8
        col = pd.Index(names).get_indexer(rows["source"])
        order = np.lexsort((col, term))
        term, col, n, total = term[order], col[order], rows["n"].to_numpy(np.int64)[order], rows["total"].to_numpy(np.int64)[order]
        kept_terms = int(groups["terms"].iloc[0])
        m, whole = groups["n"].to_numpy(np.int64) + 5 * kept_terms, int(groups["lang_n"].iloc[0]) + 5 * kept_terms
        p, more = scaled(n, m[col]), None
        add("pair", a, names[b], differences(term, col, p, scaled(0, m))[a, b])
        more = p - scaled(total, whole)
        at = np.flatnonzero(more > 0)
        at = at[np.lexsort((term[at], -more[at], col[at]))]
        begin = np.flatnonzero(np.diff(col[at], prepend=-1) != 0)
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        at = at[rank < top]
        add("term", col[at], words[term[at]], more[at])
    elif shard == 0:
        add("pair", a, names[b], np.zeros(len(a), np.int64))
    return pd.DataFrame(out)


def audit(docs: DataFrame, documents: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source; further columns don't matter), null ones as empty.

    Terms are runs of letters A-Z, a-z and of other than ASCII characters, A-Z in
    lower case. A lang keeps those that `documents` of its rows have or more. A
    group (lang, source) and each lang give a kept term p = 1 + floor(10**9 (count
    + 5) / (N + 5 V)): N occurrences of V kept terms. Part `pair`: for each other
    source of the lang, the sum of abs(p - q) over all kept terms. Part `term`: the
    `top` terms that the group has and gives more than its lang does, by how much
    more. Ranks are by value descending, then by item in the order of UTF-8. Each
    row is a document, repeated ones too. Groups without terms have pairs; a lang
    with one source has none. An empty table gives an empty result.

    The result has a row for each two sources of a lang, and a shard one sum for
    each, so memory and work grow with the square of a lang's sources.
    """
    found = stored(kept(terms(docs), documents))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = found.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("first").cast("long")).alias("terms"))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "lang_n", "terms"])
    shards = max(1, -(-found.count() // COUNTS))
    rows = found.select("lang", "source", "term", "n", "total", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    each = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    own = rows.groupBy("lang", "shard").cogroup(each.groupBy("lang", "shard")).applyInPandas(lambda key, left, right: shares(key, left, right, top), "lang string, source string, part string, item string, value long")
    sums = own.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one shard
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def sql(documents: int = 30, top: int = 50) -> str:
    """DuckDB SQL for audit(documents)."""
    return f"""
WITH own AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
     word AS (SELECT k, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM own),
     vocabulary AS (SELECT lang, term, count(*) AS total FROM word GROUP BY lang, term HAVING count(DISTINCT k) >= {documents}),
     grp AS (SELECT DISTINCT lang, source FROM own),
     counted AS (SELECT lang, source, term, count(*) AS n FROM word GROUP BY ALL),
     dense AS (SELECT g.lang, g.source, v.term, v.total, coalesce(c.n, 0) AS n FROM grp AS g JOIN vocabulary AS v USING (lang) LEFT JOIN counted AS c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
     p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
             1 + (1000000000::HUGEINT * (total + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM dense),
     pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p AS x JOIN p AS y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
              FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source),
     term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
     ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
                UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
