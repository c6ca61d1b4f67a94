"""Patches against a small tree patcher, operation by operation."""

import copy
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from orrery.sources import patches as P
from orrery.sources import snapshot_xml as X

BASE = """<wares><ware id="a" name="A"><price min="1" average="2" max="3"/><production method="default" time="5"><primary><ware ware="b" amount="2"/></primary></production></ware>
<ware id="b" name="B"><price min="4" average="5" max="6"/></ware><ware id="c" tags="x/y"><price min="7"/><production method="default"/><production method="teladi"/></ware><group><ware id="a"/></group></wares>"""
PATCHES = [
    """<diff><replace sel="/wares/ware[@id='a']/price/@average">20</replace><remove sel="/wares/ware[@id='b']/price"/><add sel="/wares/ware[@id='b']"><price min="40"/><note/></add>
<add sel="/wares"><ware id="d"><price min="9"/></ware><ware id="e"/></add><add sel="//ware[@id='c']/production[@method='teladi']" type="@amount">3</add><replace sel="/wares/ware[@id='zz']"><ware id="no"/></replace><remove sel="/wares/ware[@id='c']/@tags"/></diff>""",
    """<diff><add sel="/wares/ware[@id='d']/price" pos="after"><late n="1"/></add><add sel="/wares/ware[@id='d']/price" pos="after"><late n="2"/></add><add sel="/wares/ware[@id='d']/price" pos="before"><early n="1"/><early n="2"/></add><add sel="/wares/ware[@id='d']" pos="prepend"><first/></add>
<replace sel="/wares/ware[@id='a']/production[@method=&quot;default&quot;]"><production method="default" time="50"><primary><ware ware="e" amount="1"/></primary></production><production method="new"/></replace><replace sel="/wares/ware[@id='a']/price/@average">21</replace><add sel="/wares/ware[@id='a']/price" type="@extra"> q </add></diff>""",
    """<diff><remove sel="/wares/ware[@id='d']"/><add sel="/wares/ware[@id='d']"><lost/></add><add sel="/wares"><ware id="d" again="1"/></add><add sel="/wares/ware[@id='d']"><found/></add><remove sel="/wares/ware[@id='e']"/><remove sel="/wares/group//ware[@id='a']"/><add sel="/wares/ware[2]"><unread/></add><add sel="/wares/ware[@id='a']/production[@method='new']/primary"><none/></add></diff>""",
]


def by_hand(base, patches):
    """Each operation in its turn on a tree."""
    root = ET.fromstring(base)
    top = ET.Element("top")
    top.append(root)
    for text in patches:
        for op in ET.fromstring(text):
            sel = op.get("sel")
            if "ware[2]" in sel:
                continue
            path, _, attribute = sel.partition("/@")
            attribute = attribute or (op.get("type") or "")[1:]
            holders = {c: p for p in top.iter() for c in p}
            for e in top.findall("." + path):
                up = holders[e]
                at = list(up).index(e)
                if attribute:
                    e.attrib.pop(attribute, None)
                    if op.tag != "remove":
                        e.set(attribute, op.text.strip())
                    continue
                new, pos = [copy.deepcopy(x) for x in op], op.get("pos")
                if op.tag != "add":
                    up.remove(e)
                if op.tag == "add" and pos in (None, "prepend"):
                    e[len(e) if pos is None else 0 : len(e) if pos is None else 0] = new
                elif op.tag != "remove":
                    k = at + (pos == "after")
                    up[k:k] = new
    return [(depth, e.tag, dict(e.attrib)) for depth, e in walk(root, 1)]


def walk(e, depth):
    yield depth, e
    for c in e:
        yield from walk(c, depth + 1)


@pytest.fixture(scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cut")))


def elements(spark, folder, base, patches):
    for turn, text in enumerate([base, *patches]):
        (folder / f"{turn}.xml").write_text(text)
    turn = F.regexp_extract("file", r"(\d+)\.xml$", 1).cast("int")
    return X.elements(spark, str(folder)).withColumns({"doc": F.lit("wares"), "turn": turn})


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_patches_match_a_tree_that_is_patched_by_hand(spark, checkpoints, tmp_path, n):
    nodes, unread = P.patched(elements(spark, tmp_path, BASE, PATCHES[:n]))
    got = [(len(r.steps), r.tag, r.attrs) for r in nodes.orderBy("place").collect()]
    assert got == by_hand(BASE, PATCHES[:n])
    assert [r.sel for r in unread.collect()] == (["/wares/ware[2]"] if n == 3 else [])


def test_empty_tables_have_no_nodes(spark, checkpoints, tmp_path):
    none = elements(spark, tmp_path, BASE, []).limit(0)
    nodes, unread = P.patched(none)
    assert nodes.count() == unread.count() == 0
