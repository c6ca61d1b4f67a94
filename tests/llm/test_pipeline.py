"""The pipeline's stages, each judged on its own input."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import mixing, queries, simhash, tokens


def test_stages_take_effect(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
        sizes.append(docs.count())
        if name == "near-duplicates":
            groups = simhash.near_duplicates(before).toPandas()
            assert {r.doc_id for r in docs.collect()} == set(groups.component_id)
        if name == "token blocks":
            rows = docs.orderBy("start").collect()
            assert [r.doc_id for r in rows] == sorted(r.doc_id for r in before.select("doc_id").collect())
            assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4] > 0


def test_stages_on_odd_rows(spark, data):
    """Nulls, empty and long texts, repeated rows, empty tables, and further columns that have the operators' own names."""
    text = "plain words of no meaning that stand here in a row for some time and then end"
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, text, None, "a", 9), (4, text, "en", "b", 9), (4, text, "en", "b", 9), (None, text + " twice", None, None, None), (5, " \t\n ", "de", "b", 4), (7, "word and " * 30_000, "en", "a", 9)]
    names = ("keep", "perplexity", "lo", "hi", "n_symbols", "copy", "shuffle_key", "fp", "fingerprint", "component_id", "item_id", "start", "n", "half", "gram", "hash", "quality", "root", "first")
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in names}).cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, data)
        assert stage(spark, odd.limit(0), data).count() == 0
        if name == "token blocks":
            assert out.count() == len(rows)
            continue
        assert out.columns == odd.columns
        got = out.collect()
        assert set(got) <= set(odd.collect()) and all(r[c] == f"own {c}" for r in got for c in names)
        if name == "near-duplicates":
            assert sorted((r.doc_id or 0 for r in got), key=str) == [0, 1, 3, 7]
        if name == "decontamination":
            assert len(got) == len(rows)
        if name == "quality":
            assert not {1, 2} & {r.doc_id for r in got}


def test_mixing_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(mixing.sql()).fetchall()
    got = queries.op6_mixing(spark, data).select("doc_id", "source", "text_md5", "copy", "shuffle_key").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))
    assert tokens.BLOCK == 128
