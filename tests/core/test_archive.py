import gzip
import hashlib

from orrery.plans.relational import checkpoints
from orrery.sources import archive as A
from orrery.sources import snapshot_xml as X


def pack(folder, name, files):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.cat").write_text("".join(f"{p} {len(d)} 1700000000 {hashlib.md5(d).hexdigest()}\n" for p, d in files) + "broken line\n")
    (folder / f"{name}.dat").write_bytes(b"".join(d for _, d in files))


def test_index_and_payloads(spark, tmp_path):
    root = tmp_path / "g"
    pack(root, "01", [("t/a b.xml", b"one"), ("t/c.xml", b"three")])
    pack(root, "02", [("t/c.xml", b"newer!"), ("loose.txt", b"packed")])
    pack(root, "02_sig", [("t/c.xml", b"sign")])
    pack(root / "extensions" / "ego_dlc_x", "ext_01", [("t/c.xml", b"dlc")])
    pack(root / "extensions" / "mod", "ext_01", [("m.txt", b"mod")])
    (root / "03.cat").write_text("no.dat 3 1 x\n")
    (root / "loose.txt").write_bytes(b"loose")
    found = A.index(spark, str(root))
    assert {(r.path, r.size, r.offset, r.source) for r in found.collect()} == {("t/a b.xml", 3, 0, ""), ("t/c.xml", 6, 0, ""), ("loose.txt", 6, 6, ""), ("extensions/ego_dlc_x/t/c.xml", 3, 0, "ego_dlc_x")}
    assert {r.path: bytes(r.data) for r in A.payloads(spark, str(root), found).collect()} == {"t/a b.xml": b"one", "t/c.xml": b"newer!", "loose.txt": b"loose", "extensions/ego_dlc_x/t/c.xml": b"dlc"}
    assert [r.path for r in A.glob(found, "t/|x").collect()] == ["t/a b.xml", "t/c.xml"]
    assert "extensions/mod/m.txt" in {r.path for r in A.index(spark, str(root), ["mod"]).collect()}


def test_texts_refer_to_each_other(spark, tmp_path):
    checkpoints(spark)
    (tmp_path / "a.xml").write_text('<language><page id="1"><t id="1">Old</t><t id="2">{1,1} (note (inner)) {1, 3}</t><t id="3">\\(kept\\)</t><t id="4">{1,4}!</t></page><page id="x"><t id="1">no</t></page></language>')
    (tmp_path / "b.xml").write_text('<diff><add><page id="1"><t id="1">New</t><t id="5"/></page></add></diff>')
    known = A.texts(X.elements(spark, str(tmp_path)))
    assert {(r.page, r.id): r.text for r in known.collect()}[1, 1] == "New" and known.count() == 5
    df = spark.createDataFrame([(1, "a {1,2} b"), (2, "{9,9}"), (3, None), (4, "plain"), (5, "{1,4}"), (6, "{1,5}{1,1}{1,1}"), (7, "")], "k int, name string")
    got = {r.k: r.name for r in A.resolved(df, "k", "name", known).collect()}
    assert got == {1: "a New  (kept) b", 2: "{9,9}", 3: None, 4: "plain", 5: "{1,4}" + "!" * 9, 6: "NewNew", 7: ""}
    A.dump(known, str(tmp_path / "out"))
    lines = "".join(gzip.decompress(p.read_bytes()).decode() for p in sorted((tmp_path / "out").glob("*.gz"))).split("\n")
    assert lines[0] == "page,id,text" and lines[1] == "1,1,New"


def test_reference_tables_with_overrides(spark, tmp_path):
    own, packaged = tmp_path / "own", tmp_path / "packaged"
    own.mkdir(), packaged.mkdir()
    (packaged / "a.csv").write_text("id,size\nx,1\n")
    (packaged / "b.csv").write_text("id,size\nx,1\n")
    (own / "a.csv").write_text("size,id,more\n5,y,z\n")
    (own / "b.csv").write_text("id\ny\n")
    read = lambda name: A.overlaid(spark, name, str(own), str(packaged), "id string, size int, kind string", {"kind": "k"})
    told = {n: ([tuple(r) for r in read(n)[0].collect()], read(n)[1]) for n in ("a.csv", "b.csv", "c.csv")}
    assert told == {"a.csv": ([("y", 5, "k")], []), "b.csv": ([("x", 1, "k")], ["size"]), "c.csv": ([], [])}
