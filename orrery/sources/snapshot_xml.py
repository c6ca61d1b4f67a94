"""World snapshots: nested XML as a table of elements, and records as filters and projections of it.

A small streaming reader turns each document into rows of one shape, whatever is
in it: an element's place, its attributes and the components around it. What a
record is (an offer, a build task, a fleet link) is then a predicate on those
columns, so new records are new expressions, and Spark prunes and plans them.
A file is read by one task, as a stream, so files may have any length; small ones
share a task. A document that breaks off gives the elements before that point,
and a last row of tag `#truncated`.
"""

from __future__ import annotations

import io
import xml.parsers.expat
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.columns import cents, empty_to_null, to_double

COMPONENT = "struct<ord:long,class:string,id:string,macro:string,owner:string,connection:string>"
ELEMENT = f"file string, ord long, parent long, depth int, tag string, path string, attrs map<string,string>, comps array<{COMPONENT}>, text string"


#: Bytes that are read at once, and that a packed chunk is unpacked to at once; elements that are sent to Spark at once.
CHUNK, UNPACKED, BATCH = 1 << 18, 1 << 22, 10_000


def chunks(stream: BinaryIO, size: int = CHUNK) -> Iterator[bytes]:
    """A file's bytes piece by piece, unpacked if it is a gzip file. One that is cut short raises EOFError, one that is damaged zlib.error."""
    data = stream.read(size)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(size)
        return
    unpack = zlib.decompressobj(31)
    while data:
        yield unpack.decompress(data, UNPACKED)
        if unpack.eof:  # of a member; others may follow
            data, unpack = unpack.unused_data or stream.read(size), zlib.decompressobj(31)
            if not data:
                return
        else:
            data = unpack.unconsumed_tail or stream.read(size)
    raise EOFError("the file is cut short")


def parse(stream: BinaryIO, tags: frozenset[str] | None = None, until: str | None = None) -> Iterator[tuple]:
    """(ord, parent, depth, tag, path, attrs, comps, text) of a document's elements, in order of their starts; those of `tags` alone, up to the end of `until`."""
    stack: list[list] = []
    comps: list[dict] = []  # replaced, not changed, as rows hold it
    out: list[list] = []
    state = {"n": 0, "stop": False}

    def start(tag: str, attrs: dict) -> None:
        nonlocal comps
        n = state["n"] = state["n"] + 1
        if tag == "component":
            comps = [*comps, {"ord": n, "class": attrs.get("class"), "id": attrs.get("id"), "macro": (attrs.get("macro") or "").lower(), "owner": attrs.get("owner"), "connection": attrs.get("connection")}]
        path = f"{stack[-1][1]}/{tag}" if stack else tag
        row = [n, stack[-1][0] if stack else None, len(stack) + 1, tag, path, attrs, comps, None] if tags is None or tag in tags else None
        stack.append([n, path, tag, row])
        if row:
            out.append(row)

    def characters(text: str) -> None:
        row = stack[-1][3] if stack else None
        if row and text.strip():
            row[7] = (row[7] or "") + text

    def end(tag: str) -> None:
        nonlocal comps
        stack.pop()
        if tag == "component":
            comps = comps[:-1]
        if tag == until:
            state["stop"] = True

    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        for chunk in chunks(stream, 1 << 14 if until else CHUNK):
            parser.Parse(chunk, False)
            yield from out[:-64] if stack else out  # the last may still get text
            del out[: max(0, len(out) - 64) if stack else len(out)]
            if state["stop"]:
                break
        if not state["stop"]:
            parser.Parse(b"", True)
    except (xml.parsers.expat.ExpatError, EOFError, zlib.error):
        if not state["stop"]:
            out.append([state["n"] + 1, None, 0, "#truncated", "#truncated", {}, [], None])
    yield from out


def batches(file: str, stream: BinaryIO, tags: frozenset[str] | None = None, until: str | None = None) -> Iterator[pa.RecordBatch]:
    """parse() as ELEMENT rows, column by column."""
    text = pa.string()
    around = pa.list_(pa.struct([("ord", pa.int64()), *[(c, text) for c in ("class", "id", "macro", "owner", "connection")]]))
    rows = parse(stream, tags, until)
    while held := list(islice(rows, BATCH)):
        ord_, parent, depth, tag, path, attrs, comps, said = zip(*held)
        keys, values = pa.array(list(chain.from_iterable(attrs)), text), pa.array(list(chain.from_iterable(x.values() for x in attrs)), text)
        own = {id(c): c for c in comps}  # elements in the same component hold the same list
        place = {k: i for i, k in enumerate(own)}
        columns = {
            "file": pa.repeat(pa.scalar(file, text), len(held)), "ord": pa.array(ord_, pa.int64()), "parent": pa.array(parent, pa.int64()), "depth": pa.array(depth, pa.int32()), "tag": pa.array(tag, text), "path": pa.array(path, text),
            "attrs": pa.MapArray.from_arrays(pa.array(accumulate(map(len, attrs), initial=0), pa.int32()), keys, values), "comps": pa.array(list(own.values()), around).take(pa.array([place[id(c)] for c in comps], pa.int64())), "text": pa.array(said, text),
        }
        yield pa.RecordBatch.from_pydict(columns)


def elements(spark: SparkSession, path: str, tags: frozenset[str] | None = None, until: str | None = None, suffixes: tuple[str, ...] = (".xml", ".xml.gz")) -> DataFrame:
    """ELEMENT rows of all files of these suffixes under path. tags keeps those elements alone; until stops each file behind the first such element.

    Tasks open the files themselves, by the data source `world_snapshot`. In a
    store that only Spark reads a file comes as one value, and so has 2 GB at most.
    """
    from .snapshot_source import SnapshotSource, readable

    if readable(path):
        spark.dataSource.register(SnapshotSource)
        options = {"path": path, "suffixes": ",".join(suffixes)} | ({"tags": ",".join(sorted(tags))} if tags else {}) | ({"until": until} if until else {})
        return spark.read.format(SnapshotSource.name()).options(**options).load()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(path).select("path", "content")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, data in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                yield from batches(file, io.BytesIO(data), tags, until)

    return files.mapInArrow(run, ELEMENT)


def peek(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, guid, game_time, save_date): a file's header. No more of a file is read than some 16 KB beyond it."""
    e = elements(spark, path, frozenset({"game", "save", "info"}), "info", **options)
    return e.groupBy("file").agg(F.max(F.when(at("game"), a("guid"))).alias("guid"), F.max(F.when(at("game"), to_double(a("time")))).alias("game_time"), F.max(F.when(at("save"), a("date"))).alias("save_date"))


def a(name: str) -> Column:
    return empty_to_null(F.try_element_at("attrs", F.lit(name)))


def at(*tail: str) -> Column:
    """Whether an element's path ends in these tags."""
    end = "/".join(tail)
    return F.endswith("path", F.lit(f"/{end}")) | (F.col("path") == end)


def last(keep=None) -> Column:
    """The innermost component around an element that keep() accepts."""
    return F.try_element_at(F.filter("comps", keep) if keep else F.col("comps"), F.lit(-1))


def is_ship(c: Column) -> Column:
    return F.startswith(c["class"], F.lit("ship_"))


def is_yard(c: Column) -> Column:
    return c["class"].isin("station", "buildstorage")


def place(kind: str) -> Column:
    return last(lambda c: c["class"] == kind)


def is_vault() -> Column:
    """Whether a component is a data vault: by its class, or a landmark that is called so."""
    words = F.split(F.lower(F.coalesce(a("macro"), F.lit(""))), "_")
    return (a("class") == "datavault") | ((words[0] == "landmarks") & F.array_contains(words, "vault"))


def number(name: str, default: float | None = None) -> Column:
    value = to_double(a(name))
    return value if default is None else F.coalesce(value, F.lit(default))


def under(*tags: str) -> Column:
    """Whether an element has ancestors of these tags, in this order, right above it."""
    return F.col("path").rlike("(?:^|/)" + "/".join(tags) + "/[^/]+$")


def component(kind: Column) -> Column:
    return (F.col("tag") == "component") & kind


@cache
def definitions() -> dict[str, tuple[Column, dict[str, Column]]]:
    """Record name: (predicate, columns). Each is a row of what the predicate holds for.

    Fixed values: the names of elements, attributes, classes and paths are the document format's.
    """
    host = last(lambda c: is_yard(c) | is_ship(c))["id"]
    thing = last(lambda c: (c["class"] == "station") | is_ship(c))["id"]
    own = last()
    pending = {"trade_id": a("id"), "host": host, "reserver": a("reserver"), "partner": a("partner"), "ware": a("ware"), "amount": number("amount", 0), "desired": number("desired", 0), "transferred": number("transferred", 0), "price_cr": cents(a("price")), "escrow_cr": cents(a("escrow")), "flags": a("flags"), "expires_at": number("time"), "buyer_id": F.coalesce(a("buyer"), F.when(a("seller").isNotNull(), a("partner"))), "seller_id": F.coalesce(a("seller"), F.when(a("buyer").isNotNull(), a("partner")))}
    tracked = a("class").isin("cluster", "sector", "station", "buildstorage") | F.startswith(a("class"), F.lit("ship_"))
    outer = F.try_element_at(F.filter(F.slice("comps", 1, F.greatest(F.size("comps") - 1, F.lit(0))), lambda c: c["class"].isin("cluster", "sector", "station", "buildstorage") | is_ship(c)), F.lit(-1))

    return {
        "info": (under("savegame", "info"), {"tag": F.col("tag"), "guid": a("guid"), "version": a("version"), "game_time": number("time"), "save_date": a("date"), "name": a("name"), "money": number("money"), "modified": a("modified")}),
        "component": (component(tracked), {"id": a("id"), "class": a("class"), "macro": F.lower(a("macro")), "name": a("name"), "code": a("code"), "owner": a("owner"), "knownto": a("knownto"), "contested": a("contested"), "connection": a("connection"), "spawntime": number("spawntime"), "basename": a("basename"), "cluster_id": place("cluster")["id"], "cluster_macro": place("cluster")["macro"], "sector_id": place("sector")["id"], "sector_macro": place("sector")["macro"], "parent_id": outer["id"]}),
        "built_ref": (component(a("construction").isNotNull() & (F.coalesce(a("state"), F.lit("")) != "construction")), {"host": last(is_yard)["id"], "entry": a("construction")}),
        "datavault": (component(is_vault()), {"id": a("id"), "macro": F.lower(a("macro")), "code": a("code"), "knownto": a("knownto"), "sector_macro": place("sector")["macro"]}),
        "vault_unlock": (F.col("path").endswith("component/unlock") & (a("state") == "unlocked"), {"id": own["id"]}),
        "wormhole": (component(a("class") == "anomaly"), {"id": a("id"), "macro": F.lower(a("macro")), "code": a("code"), "knownto": a("knownto"), "cluster_macro": place("cluster")["macro"], "sector_macro": place("sector")["macro"]}),
        "wormhole_link": ((own["class"] == "anomaly") & F.col("path").rlike("component/connections/connection/connected$") & F.col("tag").isin("connected"), {"id": own["id"], "target_conn": a("connection"), "conn": F.lit(None).cast("string")}),
        "wormhole_transition": ((F.col("tag") == "transition") & (own["class"] == "anomaly"), {"id": own["id"], "destination": F.coalesce(a("destination"), F.lit(""))}),
        "highway": (component(a("class") == "highway"), {"id": a("id"), "sector_macro": place("sector")["macro"]}),
        "ammunition": (at("ammunition", "available", "item") & (own["class"] == "station"), {"station_id": own["id"], "macro": F.lower(a("macro")), "amount": number("amount")}),
        "player_subscription": (at("memory", "subscriptions", "item") & F.exists("comps", lambda c: c["class"] == "player"), {"object_id": a("component"), "expires_at": number("time")}),
        "player_scan": (at("memory", "scan", "item") & F.exists("comps", lambda c: c["class"] == "player"), {"object_id": a("component"), "level": number("level")}),
        "player_stat": (F.col("path") == "savegame/stats/stat", {"id": a("id"), "value": number("value")}),
        "extension": ((F.col("tag") == "patch") & a("extension").isNotNull(), {"id": a("extension"), "version": a("version"), "name": a("name")}),
        "module_production": (at("component", "production"), {"host": last(is_yard)["id"], "macro": own["macro"], "state": a("state"), "elem": F.col("ord")}),
        "module_efficiency": (at("component", "production", "efficiency"), {"elem": F.col("parent"), "efficiency": number("product")}),
        "module_ware": (F.col("path").rlike("component/production/queue(/item)?$") & a("ware").isNotNull(), {"comp": own["ord"], "ware": a("ware")}),
        "build_price_factor": (at("trade", "prices") & a("buildpricefactor").isNotNull(), {"object_id": host, "factor": number("buildpricefactor")}),
        "station_build_method": (at("component", "build") & a("method").isNotNull() & a("order").isNull() & is_yard(own), {"object_id": own["id"], "method": a("method")}),
        "build_task": ((F.col("tag") == "build") & (a("type").isNotNull() | a("order").isNotNull()) & ~(at("component", "build") & a("method").isNotNull() & a("order").isNull() & is_yard(own)), {"host_id": last(is_yard)["id"], "comp_id": own["id"], "kind": F.when(a("id").isNotNull(), "task").otherwise("progress"), "task_id": F.coalesce(a("id"), a("order")), "ctx": F.when(at("component", "build"), "processor").otherwise(F.try_element_at(F.split("path", "/"), F.lit(-2))), "type": a("type"), "target_id": a("component"), **{n: a(n) for n in ("builder", "faction", "flags", "preexisting", "method", "state")}, "time": number("time"), "step": number("step"), "steps": number("steps"), "start_time": number("start"), "end_time": number("end"), "sequence_index": number("sequenceindex"), "macro": F.lower(a("macro"))}),
        "commander_link": ((F.col("tag") == "connected") & a("connection").isNotNull(), {"follower": host, "conn": a("connection"), "elem": F.col("parent")}),
        "connection": ((F.col("tag") == "connection") & a("connection").isNotNull(), {"object_id": host, "kind": a("connection"), "conn": a("id"), "elem": F.col("ord")}),
        "post": (at("control", "post"), {"object_id": host, "post": a("id"), "npc": a("component")}),
        "workforce": ((F.col("tag") == "workforce") & a("race").isNotNull(), {"station_id": host, "race": a("race"), "amount": number("amount")}),
        "log_entry": (at("log", "entry"), {"t": number("time"), "category": F.coalesce(a("category"), F.lit("")), "title": a("title"), "text": a("text"), "money": number("money"), "interact": a("interact"), "component": a("component"), "raw": F.to_json("attrs")}),
        "plan_entry": (at("sequence", "entry") & a("index").isNotNull() & a("macro").isNotNull(), {"host_id": host, "index": number("index"), "macro": F.lower(a("macro")), "entry_id": a("id"), "elem": F.col("ord")}),
        "npc": (component((a("class") == "npc") & (a("owner") == "player")), {"id": a("id"), "name": a("name"), "code": a("code"), "owner": a("owner")}),
        "npc_skill": ((F.col("tag") == "skills") & (own["class"] == "npc") & (own["owner"] == "player"), {"npc_id": own["id"], "skills": F.col("attrs")}),
        "cargo": (at("cargo", "ware") | at("cargo", "summary", "ware"), {"object_id": host, "ware": a("ware"), "amount": number("amount", 1)}),
        "station_supply": ((at("supplies", "orders", "ware") | at("supplies", "wares", "ware")) & is_yard(own), {"object_id": own["id"], "kind": F.when(at("supplies", "orders", "ware"), "order").otherwise("ware"), "ware": a("ware"), "amount": number("amount", 1)}),
        "price_setting": (at("prices", "reference", "ware") | at("prices", "override", "ware"), {"object_id": host, "kind": F.try_element_at(F.split("path", "/"), F.lit(-2)), "ware": a("ware"), "buy": F.nullif(number("buy"), F.lit(0.0)), "sell": F.nullif(number("sell"), F.lit(0.0))}),
        "ware_limit": ((F.col("tag") == "ware") & F.col("path").rlike("overrides/(max|buy|sell)/ware$"), {"object_id": host, "kind": F.try_element_at(F.split("path", "/"), F.lit(-2)), "ware": a("ware"), "amount": number("amount", 1)}),
        "build_resource": (F.col("path").rlike("resources/(insufficient|shortage)/ware$"), {"host": host, "kind": F.try_element_at(F.split("path", "/"), F.lit(-2)), "ware": a("ware"), "amount": number("amount", 1)}),
        "ship_order": ((F.col("tag") == "order") & a("order").isNotNull(), {"object_id": host, "order": a("order"), "is_default": F.coalesce(a("default") == "1", F.lit(False)).cast("int"), "state": a("state")}),
        "trade_offer": (F.endswith("tag", F.lit("trade")) & F.col("path").rlike("trade/offers/.*trade$") & (a("buyer").isNotNull() | a("seller").isNotNull()), {"object_id": host, "side": F.when(a("buyer").isNotNull(), "buy").otherwise("sell"), "ware": a("ware"), "amount": number("amount", 0), "price_cr": cents(a("price")), "flags": F.coalesce(a("flags"), F.lit("")), "desired": number("desired")}),
        "trade_active": (at("trade", "active", "trade"), {"trade_id": a("id")}),
        "trade_pending_order": (F.col("path").rlike("orders/order/(.*/)?trade$") & a("id").isNotNull() & a("ware").isNotNull(), pending),
        "trade_pending_reservation": (at("trade", "reservations", "reservation") & a("ware").isNotNull() & a("id").isNotNull(), pending),
        "trade_setting": (at("trade", "settings", "setting") & a("wares").isNotNull(), {"object_id": host, "setting": a("name"), "ware": F.explode(F.split(a("wares"), r"\s+"))}),
        "area": ((F.col("tag") == "area") & a("yieldid").isNotNull(), {"sector_macro": place("sector")["macro"], "yieldid": a("yieldid"), "yield": number("yield", 0), "starttime": number("starttime", 0)}),
        "stock_log": (F.col("path").rlike("^savegame/economylog/entries/log$") & (a("type") == "trade"), {"t": number("time"), "owner_id": a("owner"), "ware": a("ware"), "level": F.coalesce(number("v"), F.lit(0.0)), "elem": F.col("parent"), "raw": F.to_json("attrs")}),
        "trade_log": (F.col("path").rlike("^savegame/economylog/entries/log$"), {"t": number("time"), "kind": a("type"), "ware": a("ware"), "buyer_id": a("buyer"), "seller_id": a("seller"), "price_cr": cents(a("price")), "amount": number("v"), "elem": F.col("parent"), "raw": F.to_json("attrs")}),
        "money_log": (F.col("path").rlike("^savegame/economylog/entries/log$"), {"t": number("time"), "kind": a("type"), "owner_id": a("owner"), "partner_id": a("partner"), "amount_cr": cents(F.coalesce(a("v2"), a("v"))), "elem": F.col("parent"), "raw": F.to_json("attrs")}),
        "ledger": (F.col("path") == "savegame/economylog/entries", {"elem": F.col("ord"), "block": a("type")}),
        "removed_object": (F.col("path") == "savegame/economylog/removed/object", {"id": a("id"), "name": a("name"), "code": a("code"), "owner": a("owner")}),
        "faction": (F.col("path").rlike("factions/faction$"), {"elem": F.col("ord"), "faction": a("id")}),
        "faction_child": (F.col("path").rlike("factions/faction/(relations|discounts|boosters)/(relation|booster|discount)$"), {"grand": F.col("parent"), "kind": F.when(F.col("tag") == "relation", "base").otherwise(F.col("tag")), "other": a("faction"), "value": F.coalesce(number("relation"), number("amount")), "time": number("time")}),
        "people": (F.col("tag") == "person", {"object_id": thing, "role": F.coalesce(a("role"), F.lit(""))}),
        "ship_engine": (component(a("class") == "engine"), {"object_id": last(is_ship)["id"], "macro": F.lower(a("macro"))}),
        "position": (at("component", "offset", "position"), {"comp": own["ord"], "x": number("x", 0), "z": number("z", 0)}),
    }


def records(elems: DataFrame, name: str) -> DataFrame:
    """The rows of one record, with file and ord."""
    where, columns = definitions()[name]
    return elems.filter(where).select("file", "ord", *[c.alias(n) for n, c in columns.items()])


def ledger(elems: DataFrame, block: str) -> DataFrame:
    """Rows of the economy log, typed by the block that wraps them: cargo, trade or money."""
    kind = {"cargo": "stock_log", "trade": "trade_log", "money": "money_log"}[block]
    return records(elems, kind).join(records(elems, "ledger").filter(F.col("block") == block).select("file", "elem"), ["file", "elem"]).drop("elem")


def fleet_edges(elems: DataFrame) -> DataFrame:
    """(file, follower, leader, conflict): links of `commander` connections to `subordinates` ones; the first leader counts."""
    links, conns = records(elems, "commander_link"), records(elems, "connection")
    own = links.join(conns.filter("kind = 'commander'").select("file", "elem"), ["file", "elem"]).select("file", F.col("ord").alias("f_ord"), "follower", "conn")
    lead = conns.filter("kind = 'subordinates' AND conn IS NOT NULL").select("file", F.col("ord").alias("l_ord"), F.col("object_id").alias("leader"), "conn")
    found = own.join(lead, ["file", "conn"])
    return found.groupBy("file", "follower").agg(F.min_by("leader", F.struct("l_ord", "f_ord")).alias("leader"), (F.countDistinct("leader") > 1).alias("conflict"))


def positions(elems: DataFrame) -> DataFrame:
    """(file, ord, sx, sz): each component's offsets from its sector, summed over the components between."""
    chain = F.filter("comps", lambda c: ~c["class"].isin("cluster", "sector"))
    up = elems.filter("tag = 'component'").select("file", "ord", F.explode(F.transform(chain, lambda c: c["ord"])).alias("comp"))
    at_ = records(elems, "position").select("file", "comp", "x", "z")
    return up.join(at_, ["file", "comp"], "left").groupBy("file", "ord").agg(F.sum(F.coalesce("x", F.lit(0.0))).alias("sx"), F.sum(F.coalesce("z", F.lit(0.0))).alias("sz"))


def landmarks(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Components whose macro matches a pattern, whatever the case, with their place."""
    e = elements(spark, path, frozenset({"component", "position", "offset"}))
    hit = component(F.lower(a("macro")).rlike(f"(?i){pattern}"))
    found = e.filter(hit).select("file", "ord", a("id").alias("id"), F.lower(a("macro")).alias("macro"), a("class").alias("class"), a("owner").alias("owner"), place("sector")["macro"].alias("sector_macro"))
    return found.join(positions(e), ["file", "ord"], "left")


def faction_relations(elems: DataFrame) -> DataFrame:
    """(file, faction, other, kind, value, time) of the diplomacy block."""
    owner = elems.filter(F.col("path").rlike("factions/faction/(relations|discounts|boosters)$")).select("file", F.col("ord").alias("grand"), F.col("parent").alias("elem"))
    return records(elems, "faction_child").join(owner, ["file", "grand"]).join(records(elems, "faction").select("file", "elem", "faction"), ["file", "elem"]).select("file", "faction", "other", "kind", "value", "time")


def pending_trades(elems: DataFrame) -> DataFrame:
    """One row a trade id: the copy on a ship's order and that of the station's reservation, the first row's values first, and whether it is active."""
    both = records(elems, "trade_pending_order").withColumns({"ship_id": F.col("host"), "station_id": F.lit(None).cast("string")}).unionByName(records(elems, "trade_pending_reservation").withColumns({"ship_id": F.col("reserver"), "station_id": F.col("host")}))
    first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in both.columns if c not in ("file", "ord", "trade_id")}
    active = records(elems, "trade_active").select("file", "trade_id").distinct().withColumn("is_active", F.lit(1))
    return both.groupBy("file", "trade_id").agg(*first.values()).join(active, ["file", "trade_id"], "left").fillna(0, ["is_active"])


def resources(elems: DataFrame, wares: DataFrame) -> DataFrame:
    """(file, ord, sector_macro, ware, yield, level, speed, starttime) of resource areas: their names end in one of the wares (ware), its level and its speed, which may both be left out.

    Of several wares in a name the last counts. Areas that name none, or have more than two words behind it, are left out.
    """
    areas = records(elems, "area").withColumn("_words", F.split("yieldid", "_"))
    said = areas.select("file", "ord", F.posexplode("_words").alias("_at", "ware")).filter("_at > 0").join(wares.select("ware").distinct(), "ware")
    said = said.groupBy("file", "ord").agg(F.max("_at").alias("_at"))
    found = areas.join(said, ["file", "ord"]).filter(F.size("_words") - F.col("_at") <= 3)
    word = lambda k: F.get("_words", F.col("_at") + k)
    return found.select("file", "ord", "sector_macro", word(0).alias("ware"), "yield", word(1).alias("level"), word(2).alias("speed"), "starttime")


def crew(elems: DataFrame) -> DataFrame:
    return records(elems, "people").filter("object_id IS NOT NULL").groupBy("file", "object_id", "role").agg(F.count(F.lit(1)).alias("n"))
