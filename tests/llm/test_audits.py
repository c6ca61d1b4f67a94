"""Line removal and the audits of filters and sources against brute force, on odd rows and against their SQL."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import divergence, filters, lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BOILER = "Subscribe NOW to our newsletter for more stories"


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and columns that clash with inner names."""
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, BOILER, None, "a", 9), (4, f" \t{BOILER.upper()}\x0b\n{BOILER}\nrest", "en", "b", 9), (4, f" \t{BOILER.upper()}\x0b\n{BOILER}\nrest", "en", "b", 9)]
    rows += [(4, f"other text\n{BOILER}", "en", "b", 9), (None, BOILER, None, None, None), (None, f"x\n{BOILER}\n", None, "a", None), (6, f"{BOILER}\n\n", "de", "b", 4), (7, f"\n{BOILER}", "de", "b", 4), (8, "\n".join(f"{BOILER}\nline {i} " + "ä" * 50 for i in range(5000)), "de", "", 4)]
    rows += [(9, "\n".join(f"line {i} " + "Ä" * 50 for i in range(40)), "de", "", 4), (-5, "漢字 Ünïcödé 🙂\r\n" + "ß" * 39 + "\n" + "ß" * 40, "fr", "c", 1), (11, "\x00\x1f nul $", "fr", "c", 5), (12, " ".join(f"Word{i}" for i in range(60)), "fr", "c", 5), (13, " ".join(f"Word{i}" for i in range(60)), "fr", "d", 5)]
    rows += [(k, "ß" * 40 + " " * k, "fr", "e", 1) for k in range(20, 25)] + [(k, "ß" * 39, "fr", "e", 1) for k in range(30, 36)] + [(15, None, "en", "a", 0), (16, "", "en", "a", 0)]
    clash = {c: F.lit(7) for c in ("doc", "row", "at", "h1", "h2", "key", "n", "n_lines", "n_dropped", "last", "part", "mask", "chars", "b0", "class", "without", "filter", "step", "term", "shard", "docs", "total", "first", "value", "rank")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


def texts(df):
    return [(r.doc_id, r.text or "", r.lang or "", r.source or "") for r in df.select("doc_id", "text", "lang", "source").collect()]


def dropped(rows, chars=40, documents=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    held = defaultdict(set)
    for doc, text, *_ in rows:
        for line in text.split("\n"):
            held[key(line)].add(doc)
    last = {k: max(d for d in ids if d is not None) for k, ids in held.items() if len(k) >= chars and len(ids) >= documents}
    out = []
    for doc, text, *_ in rows:
        own = text.split("\n")
        stay = [x for x in own if last.get(key(x), doc) == doc]
        out.append((doc, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [lines.BROADCAST_KEYS, 0])
def test_lines_match_brute_force(docs, odd, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", broadcast)
    for df in (docs, odd):
        got = sorted(map(tuple, lines.digests(df).collect()), key=repr)
        assert got == dropped(texts(df)) and any(n for _, _, n, _ in got)


def test_lines_keep_other_columns_and_texts(odd):
    got = lines.deduplicated(odd)
    assert got.columns == [*(c for c in odd.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped", "kept_text"]
    assert got.filter("doc_id = 7").first().kept_text == "" and got.filter("doc_id = 9").first().kept_text.startswith("line 0")
    assert got.filter("row = 7").count() == odd.count() and got.filter("n_dropped < 0 or n_dropped > n_lines").count() == 0


def audited(rows, labels):
    good, toxic = ({r.doc_id for r in labels.collect() if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text] = min(doc, least.get(text, doc))
    fails = []
    for doc, text, _, source in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        later = text in least and (doc is None or doc > least[text])
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), later)
        fails.append((source, {c for c, x in zip("ABCDE", tests) if x}, doc in good, doc in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = own
            for k, c in enumerate(order, 1):
                gone = [f for f in alive if c in f[1]]
                shapley[c] += len(gone)
                alive = [f for f in alive if c not in f[1]]
                out[part, order, k] = [len(alive), len(gone), sum(c in f[1] for f in own) - len(gone), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone), c]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return out


@pytest.mark.parametrize("case", ["hashes", "no broadcast", "equal hashes"])
def test_filter_audit_matches_brute_force(spark, docs, labels, odd, monkeypatch, case):
    if case == "no broadcast":
        monkeypatch.setattr(filters, "BROADCAST_CLASSES", 0)
    if case == "equal hashes":  # then only lengths split classes, and whole texts decide
        monkeypatch.setattr(filters, "block_hash", lambda block: F.lit(0))
    told = spark.createDataFrame([(3, 1, 1), (4, 1, None), (4, 0, 1), (None, 1, 1), (12, 1, 0), (13, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    for df, lab in ((docs, labels), (odd, told)):
        got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filters.audit(df, lab).collect()}
        assert got == audited(texts(df), lab)


def test_texts_that_differ_in_one_block_are_not_repeats(spark):
    base = "x" * 3000
    rows = [(k, base[:at] + "y" + base[at + 1 :], "s") for k, at in enumerate((0, 63, 64, 65, 1087, 1088, 1089, 2999))] + [(8, base, "s"), (9, base, "s"), (10, base + "é", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(df, none).filter("filter_order = 'EABCD' and step = 1").first().removed == 1
    assert [(r.doc, r["class"] is not None) for r in filters.refined(filters.facts(df, none)).orderBy("doc").collect()] == [(8, True), (9, True)]


def spread(rows, documents=30, top=50):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    n, docs, langs = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        found = [w.translate(FOLD) for w in word.findall(text)]
        langs[lang].add(source)
        n.update((lang, source, w) for w in found)
        docs.update((lang, w) for w in set(found))
    out = []
    for lang, sources in langs.items():
        keep = [w for (x, w), k in docs.items() if x == lang and k >= documents]
        p = {}
        for s in sources:
            size = sum(n[lang, s, w] for w in keep)
            p[s] = {w: 1 + 10**9 * (n[lang, s, w] + 5) // (size + 5 * len(keep)) for w in keep}
        both = {w: sum(n[lang, s, w] for s in sources) for w in keep}
        q = {w: 1 + 10**9 * (both[w] + 5) // (sum(both.values()) + 5 * len(keep)) for w in keep}
        for s in sources:
            pair = [(o, sum(abs(p[s][w] - p[o][w]) for w in keep)) for o in sources if o != s]
            term = [(w, p[s][w] - q[w]) for w in keep if n[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("documents", [30, 1])
def test_divergence_matches_brute_force(docs, odd, documents):
    for df in (docs, odd):
        assert sorted(map(tuple, divergence.audit(df, documents).collect())) == spread(texts(df), documents)


def test_divergence_in_many_shards(docs, monkeypatch):
    monkeypatch.setattr(divergence, "COUNTS", 500)
    assert sorted(map(tuple, divergence.audit(docs, 3, 7).collect())) == spread(texts(docs), 3, 7)


def test_terms_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(divergence, "digest", lambda term: len(term) % 3)
    rows = ["Ab cd Éé cd " + "q" * 70, "", "cd, ab 漢字 " + "q" * 69 + "r", "ef ab_cd ABCDEFGHi abcdefghj abcdefgh"]
    group, term, n, docs = divergence.tally(pa.array(rows), np.array([0, 0, 1, 1]))
    want, seen = Counter(), Counter()
    for g, text in zip([0, 0, 1, 1], rows):
        found = [w.translate(FOLD) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        want.update((g, w) for w in found)
        seen.update((g, w) for w in set(found))
    keys = list(zip(group.tolist(), term.to_pylist()))
    assert len(keys) == len(set(keys)) and dict(zip(keys, n.tolist())) == want and dict(zip(keys, docs.tolist())) == seen


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 16)
    text = "one two three " + "x" * 100 + " four five " + "é" * 9 + "  six" * 10
    cut = list(divergence.pieces(pa.array([text])[0]))
    assert b"".join(cut) == text.encode() and len(cut) > 4
    assert [w for x in cut for w in x.split()] == text.encode().split()


def test_sparse_differences_match_dense(monkeypatch):
    rng = np.random.default_rng(2)
    dense = rng.integers(1, 50, (300, 6)) * (rng.random((300, 6)) < 0.4)
    dense = dense[dense.any(1)]
    zero = rng.integers(0, 20, 6)
    term, col = np.nonzero(dense)
    whole = np.where(dense > 0, dense, zero)
    for pairs in (1 << 20, 7):
        assert (divergence.differences(term, col, dense[term, col], zero, pairs) == np.abs(whole[:, :, None] - whole[:, None, :]).sum(0)).all()
    for count, n in ((0, 7), (10**15, 3 * 10**15 + 1), (9 * 10**14, 10**15)):
        assert int(divergence.scaled(count, n)) == 1 + 10**9 * (count + 5) // n


def test_audits_of_empty_tables(docs, labels):
    none = docs.limit(0)
    assert lines.digests(none).count() == filters.audit(none, labels).count() == divergence.audit(none).count() == 0


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_line_dedup", "op13_source_divergence"])
def test_audits_match_their_sql(spark, data, name):
    from orrery.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    out = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in out.description]
    assert sorted(map(tuple, queries.queries()[name](spark, data).select(*columns).collect())) == sorted(out.fetchall())
