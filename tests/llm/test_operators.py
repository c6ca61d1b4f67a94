"""Each operator against brute force on small tables, and on odd rows."""

import gzip
import hashlib
import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import decontaminate, language, media, mixing, quality, simhash, substring, tokens, toxicity, warc, webp
from orrery.llm.text import joined

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns that clash with inner names."""
    text = "The quick brown fox jumps over the lazy dog while seven wizards brew a most curious potion tonight"
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, text, None, "a", 9), (4, text, "en", "b", 9), (4, text, "en", "b", 9), (None, text, None, None, None), (5, " \t\n ", "de", "b", 4), (6, "!!! ???", "de", "b", 7), (7, LONG, "en", "a", len(LONG)), (-8, "Ünïcödé ß 漢字 🙂", "fr", "c", 15), (9, "\x00\x1f nul", "fr", "c", 5)]
    clash = {c: F.lit(7) for c in ("fp", "cell", "bits", "pack", "part", "data", "copy", "upto", "rate", "h", "seg", "hash", "label", "score", "perplexity", "keep", "component_id", "item_id", "toxic", "_id", "_s", "lo", "hi")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_simhash_matches_all_pairs(docs, odd):
    for df in (docs, odd.select("doc_id", "text")):
        got = simhash.near_duplicates(df).toPandas()
        texts = df.select("doc_id", "text").toPandas()
        fps = {}
        for i, t in zip(texts.doc_id, texts.text):
            fps.setdefault(simhash.fingerprint((t or "").encode()), []).append(i)
        keys = list(fps)
        root = list(range(len(keys)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a in range(len(keys)):
            for b in range(a):
                if bin(keys[a] ^ keys[b]).count("1") <= 4:
                    root[find(a)] = find(b)
        least = {}
        for k, ids in enumerate(fps.values()):
            for i in ids:
                if not pd.isna(i):
                    least[find(k)] = min(i, least.get(find(k), i))
        where = {i: k for k, ids in enumerate(fps.values()) for i in ids if not pd.isna(i)}
        assert len(got) == len(texts)
        for r in got.itertuples():
            if not pd.isna(r.doc_id):
                assert r.component_id == least[find(where[r.doc_id])] and int(r.fingerprint, 16) == keys[where[r.doc_id]]


def test_ball_hashing_links_every_close_pair():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    for n in (1, 2, 3, 4):
        fps = np.concatenate([fps, fps[:10] ^ np.array([sum(1 << int(b) for b in rng.choice(64, n, False)) for _ in range(10)], np.uint64)])
    for bits in (6, 8):
        met = set()
        row, cell = simhash.reached(fps, 0, bits, 2)
        for c in np.unique(cell):
            a, b = simhash.links(fps[row[cell == c]], int(c), bits, 2)
            met |= set(zip(a.tolist(), b.tolist()))
        assert all(bin(a ^ b).count("1") <= 64 for a, b in met)
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in met:
            root[find(a)] = find(b)
        for a in map(int, fps):
            for b in map(int, fps):
                if bin(a ^ b).count("1") <= 4:
                    assert find(a) == find(b)


def test_crowded_prefixes_are_lengthened(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)
    base, rng = 0x0123456789ABCDEF, np.random.default_rng(5)
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(40, 2, False)) for _ in range(200)})
    got = simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        root[find(r.a)] = find(r.b)
    assert len({find(f) for f in fps}) == 1


def kept_by_brute_force(table):
    first, words = {}, {}
    for i, t in sorted(table, key=lambda x: (x[0] is None, x[0] or 0)):
        w = WORDS.findall(t or "")
        words.setdefault(i, []).append(w)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, many in words.items():
        for w in many:
            gone = set()
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] != i:
                    gone.update(range(k, k + 13))
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_matches_all_windows(docs, odd, monkeypatch):
    for df in (docs, odd):
        table = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        for pack in (4 << 20, 5_000):
            monkeypatch.setattr(substring, "PACK", pack)
            got = substring.removed(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
            assert sorted((tuple(r) for r in got), key=str) == kept_by_brute_force(table)


def test_substring_spans_are_the_removed_words(docs):
    for r in substring.removed(docs).collect():
        assert sum(s.words for s in r.spans) == r.n_removed and len(WORDS.findall(r.kept_text)) == r.n_words - r.n_removed


def test_substring_holds_slices_of_a_pack(monkeypatch):
    import zstandard

    table = pa.table({"doc_id": [1, None, 3, 4, 5], "text": [LONG * 4, None, LONG, "", "a " + LONG]})
    sink, seen, real = pa.BufferOutputStream(), [], substring.hashed
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    monkeypatch.setattr(substring, "hashed", lambda data, start, end: seen.append(len(data)) or real(data, start, end))
    p = substring.Pack(zstandard.ZstdCompressor().compress(sink.getvalue()), 13)
    assert max(seen) <= 1 << 18 and (p.words == real(p.data, p.start, p.end)).all()
    sent = list(substring._rows(p, np.zeros(len(p.words), bool)))
    assert all(b.num_rows == 1 or b.nbytes < 5 << 18 for b in sent)
    assert [x for b in sent for x in b.column("kept_text").to_pylist()] == [" ".join(WORDS.findall(t or "")) for t in table["text"].to_pylist()]


def test_tokens_match_the_tokenizer(docs, odd, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_tokenizer())
    for df in (docs, odd.filter("doc_id IS NULL OR doc_id <> 4")):
        table = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        want, start = [], 0
        for i, t in table:
            ids = np.array(model.encode(t, add_special_tokens=False).ids + [1], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert sorted((tuple(r) for r in tokens.round_trip(df, most=2000).collect()), key=lambda r: r[1]) == want


def test_tokenizer_is_loaded_once_and_forgets_pieces(docs):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    encode, model = tokens.encoder(path, 40), Tokenizer.from_file(path)
    assert tokens.encoder(path, 40) is encode
    for text in [r.text or "" for r in docs.orderBy("doc_id").limit(20).collect()] * 2:
        assert encode(pa.array([text]))[0].tolist() == model.encode(text, add_special_tokens=False).ids
    asked = []
    pieces = tokens.Pieces(lambda parts: asked.append(parts) or (np.array([len(p) for p in parts], "<u4"), np.ones(len(parts), np.int64)), 4)
    for words in (["a", "bb"], ["a", "ccc"], ["a", "bb", "dddd", "eeeee"], ["bb", "a"], ["f"]):
        ids, sizes = pieces.of(pa.array(words))
        assert ids.tolist() == [len(w) for w in words] and sizes.tolist() == [1] * len(words)
    assert asked == [["a", "bb"], ["ccc"], ["dddd", "eeeee"], ["f"]] and list(pieces.at)[:2] == ["a", "bb"] and len(pieces.at) <= 5


def test_blocks_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 1000):
        for make in (lambda k: rng.integers(0, 50_000, k), lambda k: np.full(k, 7), lambda k: np.where(rng.random(k) < 0.05, 2**32 - 1, 3), lambda k: rng.integers(0, 2**32, k)):
            values = make(n).astype(np.uint32)
            s = tokens.Segment(tokens.segment([5], np.array([n]), values))
            assert (s.read() == values).all()
            for _ in range(5):
                a, b = sorted(rng.integers(0, n + 1, 2).tolist())
                assert (s.read(a, b) == values[a:b]).all()
    with pytest.raises(ValueError):
        tokens.Segment(b"nope" + bytes(40))


def test_webp_every_transform_round_trips():
    rng = np.random.default_rng(1)
    assert len(set(webp.NEAR)) == 120
    for h, w in ((1, 1), (1, 9), (13, 21)):
        pictures = [rng.integers(0, 1 << 32, (h, w), dtype=np.uint32), rng.choice(rng.integers(0, 1 << 32, 13, dtype=np.uint32), (h, w)), rng.choice(np.array([5, 0xFF00FF00], np.uint32), (h, w)), np.repeat(rng.integers(0, 1 << 32, (h, 1), dtype=np.uint32), w, 1), webp.grey(rng.integers(0, 4, (h, w)))]
        for k, picture in enumerate(pictures):
            for transforms in ((), (2,), (0,), (1,), (0, 1), (2, 0), (1, 2, 0), *(((3,),) if k else ())):
                for cache in (0, 1, 11):
                    for group in (0, 2):
                        assert (webp.decode(webp.encode(picture, transforms, cache, group)) == picture).all()


def test_webp_long_runs_and_both_decoders():
    picture = np.zeros((40, 300), np.uint32)
    picture[5:, :200] = 0xFF102030
    picture[20] = np.arange(300)
    assert (webp.decode(webp.encode(picture)) == picture).all()
    assert (webp.decode(webp.encode(picture, (), 4, 3)) == picture).all()
    data = webp.encode(webp.grey(np.random.default_rng(0).integers(0, 256, (30, 64))))
    for cut in (10, 30, len(data) // 2):
        with pytest.raises(ValueError):
            webp.decode(data[:cut])


def test_media_payloads(docs, odd):
    for df in (docs, odd):
        for r, t in zip(media.images(df, True, True).collect(), df.select("text").collect()):
            data = (t.text or "").encode()
            want = media.padded(data)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
            assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and b"".join(r.pixels).startswith(want)


def test_media_are_stored_by_what_their_samples_are_like():
    rng, (y, x) = np.random.default_rng(4), np.mgrid[0:40, 0:64]
    found = {}
    for name, samples in {"ramp": 3 * x + 5 * y, "copy": np.resize(rng.integers(0, 256, 700), (60, 64)), "pairs": np.concatenate([rng.choice(rng.permutation(256)[:2], 12) for _ in range(320)]).reshape(-1, 64), "few": rng.integers(0, 9, (30, 64)), "noise": rng.integers(0, 256, (30, 64)), "row": x[:1], "zero": 0 * x}.items():
        samples = samples.astype(np.uint8)
        media_ = media.store(samples.tobytes())
        assert (media.pixels(media_)[0] == samples).all()
        found[name] = len(media_) / len(webp.encode(webp.grey(samples), (webp.SUBTRACT_GREEN,))), webp.chosen(samples)
    assert max(found[k][0] for k in ("ramp", "copy", "pairs")) < 0.75 and found["noise"][0] == 1
    assert webp.PREDICTOR in found["ramp"][1]["transforms"] and found["copy"][1]["copies"] and found["pairs"][1]["cache_bits"] and found["few"][1] == found["zero"][1] == {"transforms": (webp.PALETTE,)}
    for n in range(300):
        h = int(rng.integers(1, 20))
        samples = (np.resize(rng.integers(0, 40, int(rng.integers(1, 300))), (h, 64)), np.cumsum(rng.integers(-3, 4, h * 64)).reshape(h, 64), np.repeat(rng.integers(0, 256, h * 8), 8).reshape(h, 64))[n % 3].astype(np.uint8)
        assert (media.pixels(media.store(samples.tobytes()))[0] == samples).all()
    long = bytes(range(256)) * 4097
    assert [len(p) for p in media.pixels(media.store(media.padded(long)))] == [16_384, 4] and b"".join(p.tobytes() for p in media.pixels(media.store(media.padded(long)))) == long


def test_language_on_held_out_rows(docs, odd, spark):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(docs).filter("held_out").collect()
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = rows(language.predict(odd, language.fit(docs)))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} == {1, 2, 5, 6}
    assert {r["lang_pred"] for r in rows(language.identify(odd.filter("lang IS NULL")))} == {"und"}


def test_language_learns_from_no_held_out_row(docs):
    relabelled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert "xx" not in language.fit(relabelled).langs


def kneser_ney(texts):
    """An interpolated modified Kneser-Ney model by dictionaries: a function from (context, code point) to the probability."""
    from collections import Counter, defaultdict

    n, start, end = quality.ORDER, chr(quality.START), chr(quality.END)
    counts = [None] * n + [Counter()]
    for t in texts:
        line = start * (n - 1) + t + end
        counts[n].update(line[i : i + n] for i in range(len(line) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    levels = []
    for k in range(1, n + 1):
        n1, n2, n3, n4 = (sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [min(max(j - (j + 1) * y * b / a if a else j / 2, 0.05), j - 0.05) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        of, total, left = {}, defaultdict(int), defaultdict(float)
        for g, c in counts[k].items():
            of[g] = d[min(c, 3) - 1]
            total[g[:-1]] += c
            left[g[:-1]] += of[g]
        levels.append((counts[k], of, total, left))

    def p(context, c):
        out = 1 / quality.POINTS
        for k, (number, off, total, left) in enumerate(levels):
            h = context[len(context) - k :]
            if h in total:
                out = (number[h + c] - off[h + c] if h + c in number else 0) / total[h] + left[h] / total[h] * out
        return out

    return p


@pytest.mark.parametrize("head", [0, 60, 1 << 19])
def test_quality_matches_dictionaries(spark, monkeypatch, head):
    monkeypatch.setattr(quality, "HEAD", head)
    rng = np.random.default_rng(7)
    words = ["the", "than", "Ünï", "кот", "котёнок", "мама", "漢字", "字", "a\x00b", "🙂", "xyz"]
    texts = [" ".join(rng.choice(words[:9], rng.integers(1, 12))) for _ in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    texts += [" ".join(rng.choice(words, 8)) for _ in range(20)] + ["кот кот кот", "zzz", "", None, "漢", chr(quality.START)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    clean = [(t or "").replace("\x00", "\ufffd").replace(chr(quality.START), "\ufffd") for t in texts]
    data, offsets = joined(pa.array([t or "" for t in texts]))
    half = quality.halves(data, offsets)
    models = [kneser_ney([clean[i] for i in range(60) if half[i] == h]) for h in (0, 1)]
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for i, t in enumerate(clean):
        line, n = chr(quality.START) * (quality.ORDER - 1) + t + chr(quality.END), quality.ORDER - 1
        want = -np.mean([np.log2(models[1 - half[i]](line[k - n : k], line[k])) for k in range(n, len(line))])
        assert got[i].n_symbols == len(t) and (got[i].perplexity is None) == (not t)
        assert not t or abs(np.log2(got[i].perplexity) - want) < 1e-4
    assert abs(sum(models[0](chr(quality.START) * 3 + "т", chr(c)) for c in range(0xFFFF)) + (quality.POINTS - 0xFFFF) * models[0](chr(quality.START) * 3 + "т", chr(0x10FFFF)) - 1) < 0.01


def test_quality_keeps_trusted_text_and_drops_noise(docs, labels, odd, spark):
    noise = spark.createDataFrame([(10**6, "%%% &&& ### *** $$$ @@@ ~~~ ^^^ " * 40, "en")], "doc_id long, text string, lang string")
    df = docs.select("doc_id", "text", "lang").union(noise)
    got = {r.doc_id: r.keep for r in quality.classify(df, labels).collect()}
    good = [r.doc_id for r in labels.filter("quality = 1").collect() if r.doc_id in got]
    assert not got[10**6] and np.mean([got[i] for i in good]) > 0.95
    out = quality.classify(odd, labels)
    assert out.count() == odd.count() and not any(r.keep for r in out.filter("n_symbols = 0").collect())


def test_quantiles_are_of_all_rows(spark):
    df = spark.createDataFrame([("a", k / 1000) for k in range(1, 1001)] + [("b", 5.0)], "lang string, bits double")
    got = {r.lang: (r.lo, r.hi, r.n) for r in quality.quantiles(df, 0.1, 0.9, 10).collect()}
    assert got["a"] == (0.1, 0.9, 1000) and set(got) == {"a", None} and got[None][2] == 1001


def test_toxicity_finds_marked_texts(spark):
    rng = np.random.default_rng(4)
    table = []
    for i in range(1200):
        words = [f"w{rng.integers(0, 300)}" for _ in range(40)]
        if i % 8 == 0:
            words[5] = words[20] = ("rotter", "cadwoman", "cadman")[i // 8 % 3]
        table.append((i, " ".join(words), int(i % 8 == 0)))
    df = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    got = toxicity.classify(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and all(r.predicted == (r.doc_id % 8 == 0) for r in held)


def test_toxicity_on_odd_rows(docs, labels, odd):
    got = rows(toxicity.classify(odd, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["score"] == 0 for r in rows(toxicity.classify(docs.limit(5), labels.limit(0))))


def test_label_model_ranks_accurate_voters_first():
    rng = np.random.default_rng(6)
    y = rng.random(4000) < 0.2
    lexicons = np.stack([np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.002).astype(int) for _ in range(16)], 1)
    patterns = (rng.random((4000, 4)) < 0.05).astype(int)
    none = np.where(lexicons.any(1), 0, -1)[:, None]
    p, table, corr = toxicity.label_model(np.hstack([lexicons, patterns, none]), 0.2)
    assert ((p > 0.5) == y).mean() > 0.9 and (table[1, :16, 2] > table[0, :16, 2]).all()


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = np.random.default_rng(8)
    items = [(k, " ".join(f"b{rng.integers(0, 500)}" for _ in range(30))) for k in range(5)]
    return spark.createDataFrame([*items, (5, None), (6, ""), (7, "short item of seven tokens in all"), (None, "Another item without an id has these twelve tokens or even a few")], "item_id long, text string")


def test_decontamination_finds_substituted_passages(spark, benchmark):
    rng = np.random.default_rng(9)
    items = {r.item_id: r.text for r in benchmark.collect()}
    table, want = [], set()
    for i in range(60):
        words = [f"w{rng.integers(0, 400)}" for _ in range(80)]
        if i % 3 == 0:
            passage = items[i % 5].upper().split()
            if i % 2:
                passage[7] = passage[18] = "other"
            words[30:30] = passage
            want.add((i, i % 5))
        table.append((i, ", ".join(words)))
    table += [(100, "x y " + items[7] + " z"), (101, None), (102, ""), (103, items[None])]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(df, benchmark).collect()}
    assert set(got) == want | {(100, 7), (103, None)}
    for (i, k), r in got.items():
        if i < 100:
            assert (r.doc_first, r.item_first, r.n_tokens, r.n_same) == (30, 0, 30, 28 if i % 2 else 30)
    assert {r.doc_id for r in decontaminate.clean(df, benchmark).collect()} == {i for i, _ in table} - {i for i, _ in got}


def test_decontamination_agrees_with_all_alignments(spark, monkeypatch):
    """Every document against every item at every shift, by counting; both ways of meeting a benchmark, and hits that no seed finds are none."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words, n)) for n in (3, 5, 6, 9, 12, 15, 19, 30)]
    docs = [" ".join(rng.choice(words, 40)) for _ in range(6)] + [None, "", "w1"]
    for item in items:
        for change in (0, 1, 2, 3):
            own = item.split()
            for k in rng.choice(len(own), min(change, len(own)), False):
                own[k] = f"x{k}"
            docs.append(" ".join([*rng.choice(words, 7), *own, *rng.choice(words, 5)]))
    want = {}
    for d, text in enumerate(docs):
        a = (text or "").split()
        for i, item in enumerate(items):
            b = item.split()
            for shift in range(-len(b), len(a)):
                equal = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
                for x in range(len(b)):
                    for y in range(x + min(12, len(b)), len(b) + 1):
                        inside = x + shift >= 0 and y + shift <= len(a)
                        if inside and sum(equal[x:y]) >= (0.8 if len(b) >= 6 else 1) * (y - x) - 1e-9:
                            want[d, i] = max(want.get((d, i), 0), sum(equal[x:y]))
    df, bench = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (decontaminate.BROADCAST_TOKENS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", most)
        got = {(r.doc_id, r.item_id): r.n_same for r in decontaminate.overlaps(df, bench).collect()}
        assert got == want


def test_a_phrase_of_all_documents_and_items_makes_no_rows(spark):
    phrase = "terms of use apply here now"
    docs = spark.createDataFrame([(i, f"{phrase} d{i} e{i} f{i}") for i in range(2000)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"a{i} b{i} {phrase} " + " ".join(f"c{i}x{k}" for k in range(9))) for i in range(300)], "item_id long, text string")
    held = decontaminate.items(bench).collect()
    known = decontaminate.Known(held)
    assert decontaminate.verified(docs, known, decontaminate.MASKS, 12, 0.8).count() == 0
    assert decontaminate.overlaps(docs.limit(50), bench).count() == 0


def test_decontamination_on_odd_rows(spark, odd, benchmark):
    assert decontaminate.clean(odd, benchmark).count() == odd.count()
    assert decontaminate.overlaps(odd, benchmark.limit(0)).count() == 0


def test_mixing_rates_and_draws(spark, docs, odd):
    mixed = mixing.mix(docs, power=0.0)
    rate = {r.source: r.rate for r in mixing.rates(docs.select("source", "text"), power=0.0).collect()}
    assert abs(mixed.count() - docs.join(spark.createDataFrame(list(rate.items()), "source string, rate double"), "source").agg(F.sum("rate")).first()[0]) < 60
    want = {}
    for r in docs.select("doc_id", "source").collect():
        u = int(hashlib.md5(f"11:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, total = 0, np.exp(-rate[r.source]), 0.0
        while total + p <= u:
            total, n = total + p, n + 1
            p *= rate[r.source] / n
        want[r.doc_id] = n
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: n for k, n in want.items() if n}
    out = mixing.mix(odd)
    assert out.filter("doc_id = 4").count() % 2 == 0 and "fp" in out.columns
    none = mixing.mix(docs, spark.createDataFrame([("src1", 1.0)], "source string, weight double"))
    assert {r.source for r in none.collect()} <= {"src1"}


def test_warc_records_round_trip(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet").limit(20)
    extra = spark.createDataFrame([(None, None, None), (1, "http://a.example/x", ""), (2, "http://a.example/b/", "<title>T &amp; t<body><p>One<br>two<script>var p='<p>no</p>'</script><a href=../c>c</a><!-- <a href=d> -->"), (2, "http://a.example/b/", "<p>again")], "page_id long, url string, html string")
    made = warc.responses(pages.union(extra).withColumn("record", F.lit(1)))
    out = warc.derivatives(made, compress=True).collect()
    assert len(out) == 2 * made.count() and all(r.digest_ok for r in out)
    by = {}
    for r in out:
        [(headers, block, error)] = warc.parse(r.record)
        assert error is None and dict(headers)["WARC-Refers-To"] == r.refers_to and warc.digest(block) == r.block_digest and len(block) == r.content_length
        by.setdefault(r.refers_to, []).append(r)
    sources = {dict(h)["WARC-Record-ID"]: dict(h) for r in made.collect() for h, *_ in warc.parse(r.record)}
    assert set(by) == set(sources)
    for k, own in by.items():
        assert {r.record_type for r in own} == {"metadata", "conversion"}
        assert all(r.target_uri == sources[k].get("WARC-Target-URI") and r.source_digest == sources[k]["WARC-Payload-Digest"] and r.payload_digest == r.block_digest for r in own)
    told = {r.record_type: r for r in out if r.page_id == 2 and r.title}
    text = next(r.text for r in out if r.record_type == "conversion" and r.refers_to == told["metadata"].refers_to)
    assert told["metadata"].title == "T & t" and told["metadata"].links == ["http://a.example/c"] and text == "One\ntwoc"
    (tmp_path / "x.warc").write_bytes(b"".join(r.record for r in made.collect()))
    assert warc.derivatives(warc.read(spark, str(tmp_path))).count() == len(out)


def made_by_hand(head, body, kind=b"response"):
    block = head + b"\r\n\r\n" + body
    return b"WARC/1.1\r\nwarc-type: " + kind + b"\r\nwarc-record-id: <urn:x:1>\r\nWARC-Target-URI: http://h.example/d/p\r\nWARC-Concurrent-To: <urn:x:2>\r\nWARC-Concurrent-To: <urn:x:3>\r\ncontent-length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_made_by_hand(spark, tmp_path):
    """Names in any case, repeated and folded headers, charsets, transfer and content encodings, and records that are none."""
    page = "<title>Caf\u00e9</title><a href='x'>\u00e9t\u00e9</a>"
    cases = [
        made_by_hand(b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nX-Long: one\r\n  two\r\nContent-Type: text/html; charset=iso-8859-1", page.encode("latin-1")),
        made_by_hand(b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\nContent-Encoding: gzip", gzip.compress(page.encode())),
        made_by_hand(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked", b"5\r\n<titl\r\n" + hex(len(page.encode()) - 5)[2:].encode() + b";x=y\r\n" + page.encode()[5:] + b"\r\n0\r\n\r\n"),
        made_by_hand(b"HTTP/1.1 200 OK", b"<meta charset='windows-1252'>" + page.encode("cp1252")),
        made_by_hand(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip", page.encode()),
        made_by_hand(b"GET / HTTP/1.1", b"", b"request"),
    ]
    bad = [b"no record at all", cases[0].replace(b"content-length: ", b"content-length: x"), cases[0][:-60], cases[0].replace(b"content-length", b"x-length")]
    rows = list(enumerate(cases + bad)) + [(100, None), (101, b""), (102, b"junk\n" + cases[0] + cases[3])]
    out = warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    good = [r for r in out if r.error is None]
    assert sorted(r.page_id for r in good) == sorted([0, 1, 2, 3, 4] * 2 + [102] * 4)
    assert {r.page_id: r.error for r in out if r.error} == {6: "not a WARC record", 7: "no valid length", 8: "cut short", 9: "no valid length", 102: "not a WARC record"}
    for r in good:
        assert r.refers_to == "<urn:x:1>" and r.digest_ok and r.title in (None, "Caf\u00e9") and (r.record_type == "metadata" or r.text.endswith("\u00e9t\u00e9"))
        assert r.record_type == "conversion" or r.links == ["http://h.example/d/x"]
    meta = json.loads(next(warc.parse(next(r.record for r in good if r.page_id == 0 and r.record_type == "metadata")))[1])
    assert meta["HTTP-Response"]["Headers"][:3] == [["Set-Cookie", "a=1"], ["set-cookie", "b=2"], ["X-Long", "one two"]]
    assert [v for k, v in meta["WARC-Header"] if k == "WARC-Concurrent-To"] == ["<urn:x:2>", "<urn:x:3>"]
    (tmp_path / "a.warc").write_bytes(b"".join(cases))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, cases)))
    read = warc.derivatives(warc.read(spark, str(tmp_path))).collect()
    assert len(read) == 20 and all(r.error is None for r in read)
    assert list(warc.parse(b"".join(map(gzip.compress, cases)))) == list(warc.parse(b"".join(cases)))


def within(seconds, run):
    """What run returns; fails if it takes longer."""
    import signal

    def late(*_):
        raise TimeoutError(seconds)

    was = signal.signal(signal.SIGALRM, late)
    signal.alarm(seconds)
    try:
        return run()
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, was)


@pytest.mark.parametrize("size", [b"-5", b"+5", b"0x5", b"5_0", b"", b" ", b"g"])
def test_warc_chunk_sizes_that_are_none(size):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked"
    body = size + b"\r\nabcdef"
    assert within(5, lambda: warc.http(head + b"\r\n\r\n" + body))[2:] == (body, body)
    cut = b"3\r\nabc\r\nffffff\r\nde"
    assert within(5, lambda: warc.http(head + b"\r\n\r\n" + cut))[3] == b"abcde"


def test_warc_reads_on_after_a_record_that_is_too_long():
    one = made_by_hand(b"HTTP/1.1 200 OK", b"page")
    long = re.sub(rb"content-length: \d+", b"content-length: 9999", one)
    for order, want in (([one, long, one, one], [None, "cut short", None, None]), ([long, one], ["cut short", None]), ([one, long], [None, "cut short"]), ([long], ["cut short"])):
        found = within(5, lambda: list(warc.parse(b"".join(order))))
        assert [e for *_, e in found] == want and all(b == found[0][1] or e for _, b, e in found if order[0] is one)


def test_warc_content_codings(spark):
    import zstandard

    page = b"<title>T</title>text"
    rows = [(1, made_by_hand(b"HTTP/1.1 200 OK\r\nContent-Encoding: br", b"\x0b\x02\x80page\x03")), (2, made_by_hand(b"HTTP/1.1 200 OK\r\nContent-Encoding: zstd", zstandard.ZstdCompressor().compress(page))), (3, made_by_hand(b"HTTP/1.1 200 OK\r\nContent-Encoding: zstd", page)), (4, made_by_hand(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip, identity", gzip.compress(page)))]
    out = warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert [(r.page_id, r.error, r.text) for r in out if r.error] == [(1, "content coding br is not known", None)]
    assert sorted((r.page_id, r.text) for r in out if r.record_type == "conversion") == [(2, "text"), (3, "text"), (4, "text")]


def test_warc_payloads_that_hold_record_lines(spark, tmp_path):
    inner = made_by_hand(b"HTTP/1.1 200 OK", b"inner")
    rows = [made_by_hand(b"HTTP/1.1 200 OK", b"<p>a\r\n\r\nWARC/1.0\r\n\r\nb"), made_by_hand(b"HTTP/1.1 200 OK", b"<p>c" + inner + inner + b"d"), made_by_hand(b"HTTP/1.1 200 OK", b"<p>e"), made_by_hand(b"HTTP/1.1 200 OK", b"")]
    for name in ("a.warc", "b.warc"):
        (tmp_path / name).write_bytes(b"".join(rows))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, rows)))
    found = [r.record for r in warc.read(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(rows * 3)
    out = warc.derivatives(warc.read(spark, str(tmp_path))).collect()
    assert len(out) == 24 and not any(r.error for r in out)
    assert list(warc.whole(iter([]))) == []


def test_webp_by_hand():
    """A file written bit by bit from the format's description: predictor, cross-colour, subtract-green, colour cache and a back-reference."""

    class Bits:
        def __init__(self):
            self.out = []

        def put(self, value, n):
            self.out += [(value >> k) & 1 for k in range(n)]

        def code(self, word):  # prefix codes go with their first bit first
            self.out += [int(c) for c in word]

        def file(self):
            data = np.packbits(np.array(self.out + [0] * (-len(self.out) % 8), np.uint8), bitorder="little").tobytes()
            chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
            return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk

    def simple(b, *symbols):  # a simple code of one or two symbols of 8 bits
        b.put(1, 1)
        b.put(len(symbols) - 1, 1)
        b.put(1, 1)
        for x in symbols:
            b.put(x, 8)

    def one_each(b, green, red=0, blue=0, alpha=0):  # an image whose pixels are all the same
        for x in (green, red, blue, alpha):
            simple(b, x)
        simple(b, 0)

    b = Bits()
    b.put(0x2F, 8)
    b.put(3, 14)  # width 4
    b.put(0, 14)  # height 1
    b.put(1, 1)  # alpha is used
    b.put(0, 3)
    b.put(1, 1)
    b.put(2, 2)  # subtract-green
    b.put(1, 1)
    b.put(1, 2)  # cross-colour, blocks of 4, an image of one pixel: red to blue 0, green to blue 16, green to red 32
    b.put(0, 3)
    b.put(0, 1)
    one_each(b, 16, 0, 32, 255)
    b.put(1, 1)
    b.put(0, 2)  # predictor, blocks of 4, mode 1
    b.put(0, 3)
    b.put(0, 1)
    one_each(b, 1, alpha=255)
    b.put(0, 1)  # no more transforms
    b.put(1, 1)
    b.put(1, 4)  # a colour cache of two
    b.put(0, 1)  # one group of codes
    # green's code lengths: 11 (a literal) has 1, 256 (a run of one pixel) and 281 (the cache's second colour) have 2.
    b.put(0, 1)
    b.put(1, 4)  # lengths of 17, 18, 0, 1, 2 in the code of lengths: 18 is `0`, 1 is `10`, 2 is `11`
    for length in (0, 1, 0, 2, 2):
        b.put(length, 3)
    b.put(0, 1)  # all 282 follow
    for word, *zeros in (("10", 11), ("11", 138, 106), ("11", 24)):
        for n in zeros:
            b.code("0")
            b.put(n - 11, 7)
        b.code(word)
    for x in (8, 9, 255, 1):  # red, blue, alpha and distance: the last names prefix 1, that is place 2 of the neighbours, the pixel to the left
        simple(b, x)
    assert (0x1E35A7BD * (255 << 24 | 8 << 16 | 11 << 8 | 9) & 0xFFFFFFFF) >> 31 == 1  # the pixel's place in the cache
    for word in ("0", "10", "11", "0"):
        b.code(word)
    # All residuals are alpha 255, red 8, green 11, blue 9. The first is added to opaque black, others to the pixel before.
    want, pixel = [], [255, 0, 0, 0]
    for _ in range(4):
        pixel = [(x + d) & 255 for x, d in zip(pixel, (255, 8, 11, 9))]
        alpha, red, green, blue = pixel
        red, blue = red + (32 * green >> 5), blue + (16 * green >> 5)  # cross-colour; green stays below 128
        want.append(alpha << 24 | (red + green & 255) << 16 | green << 8 | (blue + green & 255))
    assert webp.decode(b.file()).ravel().tolist() == want


def test_empty_tables(spark, odd, labels, benchmark, data):
    none = odd.limit(0)
    for df in (simhash.near_duplicates(none), simhash.keep_first(none), substring.removed(none), tokens.round_trip(none), media.images(none), language.identify(none), quality.classify(none, labels), toxicity.classify(none, labels), decontaminate.clean(none, benchmark), mixing.mix(none), warc.derivatives(warc.responses(spark.read.parquet(f"{data}/pages.parquet").limit(0)))):
        assert df.count() == 0


def test_quality_knows_words_of_every_script(spark):
    """Prose of Cyrillic and Chinese stays; the same letters as noise, which folded bytes can't tell apart, go. The vocabulary grows with trusted text."""
    rng = np.random.default_rng(12)
    for letters in ("абвгдежзийклмнопрст", "的一是在不了有和人这中大为上个国我以要他"):
        vocabulary = ["".join(rng.choice(list(letters), 6)) for _ in range(60)]
        after = {w: rng.choice(vocabulary, 3).tolist() for w in vocabulary}

        def prose():
            out = [vocabulary[rng.integers(60)]]
            while len(out) < 60:
                out.append(after[out[-1]][rng.integers(3)])
            return " ".join(out)

        noise = [" ".join("".join(rng.choice(list(letters), 6)) for _ in range(60)) for _ in range(10)]
        salad = [" ".join(rng.choice(vocabulary, 60)) for _ in range(10)]
        texts = [prose() for _ in range(260)]
        df = spark.createDataFrame([(k, t, "xx") for k, t in enumerate(texts + noise + salad)], "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(k, 1) for k in range(240)], "doc_id long, quality int")
        got = {r.doc_id: r.keep for r in quality.classify(df, labels).collect()}
        assert np.mean([got[k] for k in range(260)]) > 0.95 and not any(got[k] for k in range(260, 280))
    few, more = (quality.values_of(quality.model(df.filter(f"doc_id < {k}").select("text"))[0]).count() for k in (5, 200))
    assert 0 < few < more


def test_decontamination_verifies_the_longest_stretch(spark):
    """Whole items with scattered substitutions, an exact run before a worse one, and items too short for the long masks."""
    item = {k: [f"i{k}w{j}" for j in range(n)] for k, n in enumerate((15, 12, 112, *range(1, 12)))}
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in item.items()], "item_id long, text string")

    def copy(k, places):
        return (len(cases), k, " ".join(["x"] * 40 + [f"s{j}" if j in places else w for j, w in enumerate(item[k])] + ["y"] * 40))

    cases = []
    for k, places in [(0, (4, 5, 7)), (1, (5, 10)), (2, tuple(range(15, 112, 4)))] + [(k, ()) for k in item] + [(k, (p,)) for k in item if 6 <= len(item[k]) < 12 for p in range(len(item[k]))]:
        cases.append(copy(k, places))
    wrong = [copy(k, (0,)) for k in item if len(item[k]) < 6]
    df = spark.createDataFrame([(i, t) for i, _, t in cases] + [(1000 + k, t) for _, k, t in wrong], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(df, benchmark).collect()}
    assert set(found) == {(i, k) for i, k, _ in cases}
    assert all(r.n_same >= 0.8 * r.n_tokens and r.n_tokens >= min(12, len(item[k])) for (_, k), r in found.items())
    assert (found[0, 0].n_tokens, found[0, 0].n_same) == (15, 12) and (found[1, 1].n_tokens, found[1, 1].n_same) == (12, 10)


def test_no_group_of_variants_outgrows_the_crowd(spark, monkeypatch):
    """A family under one long prefix is dealt out until each group is bounded, and no variant gets lost."""
    monkeypatch.setattr(simhash, "CROWD", 20)
    base, rng = 0xF123456789ABCDEF, np.random.default_rng(14)
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(24, 2, False)) for _ in range(250)})
    got = simhash.cells(spark.createDataFrame([(f - (1 << 64),) for f in fps], "fp long"), 2).toPandas()
    size = {}
    for bits, cell, fp in zip(got.bits.tolist(), got.cell.tolist(), got.fp.tolist()):
        spent = ((fp % (1 << 64)) >> 64 - bits ^ cell % (1 << 64)).bit_count()
        size[bits, cell] = size.get((bits, cell), 0) + len(simhash.masks(64 - bits, 2 - spent))
    assert sum(size.values()) == len(fps) * 2081
    assert max(size.values()) <= 20 * 2081 and max(bits for bits, _ in size) > 18
