"""Patches of XML documents as joins: what is added, replaced and removed at the places that selectors name.

Rows are elements of documents (see snapshot_xml) with the document that they
belong to (doc) and the turn of the file: the document itself and its patches,
whose root is `diff`. Operations are numbered by turn and place. An element is
born by an operation (0: with the document) and dies by the first later one that
removes it or what holds it; an operation acts on what lives at its number. So
all operations are matched at once, and once more with what they added, until
nothing is added. A selector is matched by the attributes that elements are born
with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = 1 << 62
#: Selectors that are read: steps of tags with any tests for attributes' values, then perhaps an attribute.
STEP = r"(//?)([\w:.-]+)((?:\[\s*@[\w:.-]+\s*=\s*(?:'[^']*'|\"[^\"]*\")\s*\])*)"
TEST = r"@([\w:.-]+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\")"
ATTRIBUTE = r"/@([\w:.-]+)$"


def stepped(elems: DataFrame) -> DataFrame:
    """elems with steps (tag and attributes from the root to each), line (the numbers of these elements) and place (their order), level by level."""
    own = elems.select("doc", "turn", "ord", "parent", "depth", "tag", "attrs", "text", F.struct("tag", "attrs").alias("_step"))
    level = own.filter("depth = 1").select("*", F.array("_step").alias("steps"), F.array("ord").alias("line"))
    every, most = level, own.agg(F.max("depth")).first()[0] or 0
    for depth in range(2, most + 1):
        above = level.select("doc", "turn", F.col("ord").alias("parent"), F.col("steps").alias("_s"), F.col("line").alias("_l"))
        level = own.filter(F.col("depth") == depth).join(above, ["doc", "turn", "parent"]).select(*own.columns, F.concat("_s", F.array("_step")).alias("steps"), F.concat("_l", F.array("ord")).alias("line"))
        every = every.unionByName(level)
    return every.drop("_step")


def _tests(tests: Column) -> Column:
    """Name and value of each test of a step."""
    parts = [F.regexp_extract_all(tests, F.lit(TEST), F.lit(k)) for k in (1, 2, 3)]
    return F.zip_with(parts[0], F.zip_with(parts[1], parts[2], lambda a, b: F.concat(a, b)), lambda n, v: F.struct(n.alias("name"), v.alias("value")))


def operations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations, those whose selectors aren't read) of the stepped() rows of patches."""
    get = lambda name: F.try_element_at("attrs", F.lit(name))
    ops = rows.filter("depth = 2 AND tag IN ('add', 'replace', 'remove')").select("doc", "turn", "ord", F.col("tag").alias("kind"), get("sel").alias("sel"), get("pos").alias("pos"), F.nullif(F.regexp_replace(F.coalesce(get("type"), F.lit("")), "^@", ""), F.lit("")).alias("_type"), "text")
    ops = ops.withColumns({"attribute": F.coalesce("_type", F.nullif(F.regexp_extract("sel", ATTRIBUTE, 1), F.lit(""))), "_bare": F.regexp_replace("sel", ATTRIBUTE, "")}).drop("_type")
    known = F.coalesce(F.col("_bare").rlike(f"^(?:{STEP})+$"), F.lit(False))
    parts = [F.regexp_extract_all("_bare", F.lit(STEP), F.lit(k)) for k in (1, 2, 3)]
    good = ops.filter(known).withColumns({"_cut": parts[0], "_tags": parts[1], "_tests": F.transform(parts[2], _tests)})
    pattern = F.concat(F.lit("^"), F.array_join(F.zip_with("_cut", "_tags", lambda c, t: F.concat(F.when(c == "//", "/(?:[^/]+/)*").otherwise("/"), F.replace(t, F.lit("."), F.lit("\\.")))), ""), F.lit("$"))
    # tests by their step's place from the end, which stays where it is below a `//`
    tests = F.flatten(F.transform("_tests", lambda t, i: F.transform(t, lambda x: F.struct((F.size("_tests") - i).alias("k"), x["name"].alias("name"), x["value"].alias("value")))))
    good = good.withColumns({"tests": tests, "pattern": pattern, "tag": F.element_at("_tags", -1), "_loose": F.exists(F.transform("_tests", lambda t, i: (F.size(t) > 0) & F.exists(F.slice("_cut", i + 2, F.size("_cut")), lambda c: c == "//")), lambda x: x)})
    key = F.try_element_at(F.sort_array("tests"), F.lit(1))
    read = good.filter(~F.col("_loose")).select("doc", "turn", "ord", "kind", "pos", "attribute", "text", "pattern", "tests", "tag", F.coalesce(key["k"], F.lit(0)).alias("k"), F.coalesce(key["name"], F.lit("")).alias("name"), F.coalesce(key["value"], F.lit("")).alias("value"))
    return read, ops.filter(~known).select("doc", "turn", "ord", "kind", "sel").unionByName(good.filter("_loose").select("doc", "turn", "ord", "kind", "sel"))


def hits(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Nodes with the operations whose selectors name them: joined by document, tag and the value of one test, then verified."""
    shapes = ops.select("doc", "tag", "k", "name").distinct()
    value = F.when(F.col("name") == "", "").otherwise(F.try_element_at(F.try_element_at("steps", -F.greatest("k", F.lit(1)))["attrs"], F.col("name")))
    probe = nodes.join(shapes, ["doc", "tag"]).withColumn("value", value)
    found = probe.join(ops.withColumnRenamed("text", "op_text"), ["doc", "tag", "k", "name", "value"])
    fits = F.forall("tests", lambda t: F.try_element_at(F.try_element_at(F.col("steps"), -t["k"])["attrs"], t["name"]) == t["value"])
    return found.filter((F.col("seq") > F.col("born")) & F.expr("concat('/', array_join(transform(steps, s -> s.tag), '/')) rlike pattern") & F.coalesce(fits, F.lit(False)))


def patched(elems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, unread): the documents of elems (doc, turn, ord, parent, depth, tag, attrs, text) with all patches applied in the order of turns.

    nodes: doc, place (what they are ordered by), line, steps, tag, attrs and
    text. `add` puts its content at the end of what it names, or (pos) prepend,
    before or after; with type="@name" it sets that attribute. `replace` and
    `remove` take elements with all that they hold, or attributes. unread: (doc,
    turn, ord, kind, sel) of operations with selectors of another form. Selectors
    that name nothing do nothing. A document of several turns without `diff` is
    the union of its files, as its readers then let the last definition count.
    """
    rows = stepped(elems).checkpoint()
    patch = F.get("steps", F.lit(0))["tag"] == "diff"
    ops, unread = operations(rows.filter(patch))
    order = ops.select("doc", F.struct("turn", "ord").alias("at")).groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("_all"))  # the operations of one document
    ops = ops.join(order, "doc").withColumn("seq", F.array_position("_all", F.struct("turn", "ord"))).drop("_all").checkpoint()
    keyed = lambda c: F.flatten(F.transform(c, lambda x: F.array(x, F.lit(0).cast("long"))))
    turned = F.concat(F.array(F.col("turn").cast("long")), keyed(F.col("line")))
    mark = lambda c: F.transform(c, lambda x: F.concat(F.col("turn").cast("string"), F.lit("."), x.cast("string")))
    base = rows.filter(~patch).select("doc", F.element_at(mark(F.col("line")), -1).alias("id"), F.lit(None).cast("string").alias("origin"), mark(F.col("line")).alias("line"), F.lit(0).cast("long").alias("born"), turned.alias("place"), "steps", "tag", "attrs", "text")
    content = rows.filter(patch & (F.col("depth") > 2)).select("doc", "turn", F.get("line", F.lit(1)).alias("ord"), F.slice("steps", 3, 99).alias("_steps"), F.slice("line", 3, 99).alias("_line"), F.col("tag").alias("_tag"), F.col("attrs").alias("_attrs"), F.col("text").alias("_text"))
    born = content.join(ops.filter("kind <> 'remove' AND attribute IS NULL").select("doc", "turn", "ord", "seq"), ["doc", "turn", "ord"]).drop("turn", "ord")
    nodes, fresh, acts = base, base, None
    while True:
        now = hits(fresh, ops).select("doc", "id", "line", "born", "place", "steps", "kind", "pos", "attribute", "op_text", "seq").checkpoint()
        acts = now if acts is None else acts.unionByName(now)
        beside = (F.col("kind") == "replace") | F.coalesce(F.col("pos").isin("before", "after"), F.lit(False))
        up = lambda c: F.slice(c, 1, F.size(c) - 1)
        seq = F.col("seq")
        spot = F.when(beside & (F.coalesce("pos", F.lit("after")) == "before") & (F.col("kind") == "add"), F.concat(up(F.col("place")), F.array(F.lit(-1).cast("long"), seq))).when(beside, F.concat(up(F.col("place")), F.array(F.lit(1).cast("long"), -seq)))
        spot = spot.when(F.coalesce("pos", F.lit("")) == "prepend", F.concat("place", F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), -seq))).otherwise(F.concat("place", F.array(F.lit(LAST).cast("long"), F.lit(0).cast("long"), seq)))
        holder = lambda c: F.when(beside, up(F.col(c))).otherwise(F.col(c))
        mine = F.transform("_line", lambda x: F.concat("id", F.lit("#"), F.col("seq").cast("string"), F.lit("."), x.cast("string")))
        fresh = now.filter("kind <> 'remove' AND attribute IS NULL").withColumns({"spot": spot, "up_line": holder("line"), "up_steps": holder("steps")}).join(born, ["doc", "seq"])
        fresh = fresh.select("doc", F.element_at(mine, -1).alias("_id"), F.col("id").alias("origin"), F.concat("up_line", mine).alias("line"), seq.alias("born"), F.concat("spot", keyed(F.col("_line"))).alias("place"), F.concat("up_steps", "_steps").alias("steps"), F.col("_tag").alias("tag"), F.col("_attrs").alias("attrs"), F.col("_text").alias("text")).withColumnRenamed("_id", "id").checkpoint()
        if fresh.isEmpty():
            break
        nodes = nodes.unionByName(fresh)
    kills = acts.filter("attribute IS NULL AND kind <> 'add'").select("doc", F.col("id").alias("_at"), F.col("seq").alias("_seq"))
    fate = nodes.select("doc", "id", "born", F.explode("line").alias("_at")).join(kills, ["doc", "_at"]).filter("_seq > born").groupBy("doc", "id").agg(F.min("_seq").alias("died"))
    nodes = nodes.join(fate, ["doc", "id"], "left").checkpoint()
    # what was added to something that was gone by then, or to what was so added, never was
    target = nodes.select("doc", F.col("id").alias("origin"), F.col("died").alias("_died"))
    void = nodes.filter("origin IS NOT NULL").join(target, ["doc", "origin"]).filter("_died < born").select("doc", F.col("id").alias("_void")).distinct()
    while True:
        more = nodes.join(void.select("doc", F.col("_void").alias("origin")), ["doc", "origin"]).select("doc", F.col("id").alias("_void")).distinct()
        more = more.join(void, ["doc", "_void"], "left_anti").checkpoint()
        if more.isEmpty():
            break
        void = void.unionByName(more)
    alive = nodes.filter("died IS NULL").join(void, (nodes["doc"] == void["doc"]) & (nodes["id"] == void["_void"]), "left_anti")
    changes = acts.filter("attribute IS NOT NULL").groupBy("doc", "id", "attribute").agg(F.max_by(F.struct(F.when(F.col("kind") != "remove", F.coalesce(F.trim("op_text"), F.lit(""))).alias("v")), "seq").alias("c"))
    changes = changes.groupBy("doc", "id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "c.v"))).alias("_new"))  # those of one element
    fresh = alive.join(changes, ["doc", "id"]).withColumn("_attrs", F.map_concat(F.map_filter("attrs", lambda k, v: ~F.map_contains_key("_new", k)), F.map_filter("_new", lambda k, v: v.isNotNull())))
    below = alive.select("doc", "id", F.posexplode("line").alias("_k", "_at")).join(fresh.select("doc", F.col("id").alias("_at"), "_attrs"), ["doc", "_at"])
    below = below.groupBy("doc", "id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_attrs"))).alias("_fix"))  # the steps of one element
    steps = F.when(F.col("_fix").isNull(), F.col("steps")).otherwise(F.transform("steps", lambda s, k: F.struct(s["tag"].alias("tag"), F.coalesce(F.try_element_at("_fix", k), s["attrs"]).alias("attrs"))))
    out = alive.join(below, ["doc", "id"], "left").withColumn("steps", steps)
    return out.select("doc", "place", "line", "steps", "tag", F.element_at("steps", -1)["attrs"].alias("attrs"), "text"), unread
