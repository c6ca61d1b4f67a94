"""Derivative WARC records: metadata and plain-text conversions of response records.

Each response gives two records that refer to it (WARC-Refers-To) and carry its
target, its date and its payload's digest (as WARC-Source-Payload-Digest; the
other digests are of the record's own bytes): `metadata`, a JSON document with
the source's WARC and HTTP headers in their order, title and links, and
`conversion`, its text.
Records are kept as their bytes, so a row's bytes, or those of many rows in a
row, are a valid WARC file; compressed, each record is one gzip member.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

EPOCH = "1970-01-01T00:00:00Z"
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|(?=<body\b|</head\b)|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|footer|header|main|aside|blockquote|pre|hr|dd|dt|dl|form|title|body)\b[^>]*>", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
LINK = re.compile(r"<(a|area|link|img|script|iframe|source)\b([^>]*)>", re.I)
TARGET = re.compile(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Targets that need no resolving: whole ones, and paths from the root, without dots between slashes.
PLAIN_URL, PLAIN_PATH = re.compile(r"https?://[\w.-]+(?:/[\w~%-][\w.~%-]*)*/?"), re.compile(r"(?:/[\w~%-][\w.~%-]*)+/?")
BLANK = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")
HEAD = re.compile(rb"\r?\n\r?\n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name(*parts: str) -> str:
    """A record id that depends on the parts alone."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('\x00'.join(parts).encode()).digest()[:16], version=5)}>"


def line(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


Headers = list[tuple[str, str]]


def value(headers: Headers, key: str, default: str | None = None) -> str | None:
    """The first value of a header, whose name counts in any case."""
    return next((v for k, v in headers if k.lower() == key.lower()), default)


def record(kind: str, headers: dict[str, str], block: bytes, own: str | None = None) -> bytes:
    """A record's bytes; own: the digest of its block, if it is known."""
    told = {"WARC-Type": kind} | {k: line(v) for k, v in headers.items() if v} | {"WARC-Block-Digest": own or digest(block), "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in told.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(head: bytes, charset: str) -> Headers:
    """Header lines but the first as names and values, repeated ones in their order; a line that begins with a space goes on with the one before."""
    out: Headers = []
    for text in head.decode(charset, "replace").replace("\r\n", "\n").split("\n")[1:]:
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif text:
            key, _, told = text.partition(":")
            out.append((key.strip(), told.strip()))
    return out


def parse(data: bytes) -> Iterator[tuple[Headers, bytes, str | None]]:
    """(headers, block, error) of each record of a WARC file's bytes, compressed or not.

    What is no record, has no valid length or is cut short comes with an error,
    and reading goes on at the next line that begins a record, after its headers.
    """
    if data[:2] == b"\x1f\x8b":
        whole, rest = [], data
        try:
            while rest:
                member = zlib.decompressobj(31)
                whole.append(member.decompress(rest) + member.flush())
                rest = member.unused_data
                if not member.eof:
                    break
        except zlib.error:
            pass
        data = b"".join(whole)
    at = 0
    while at < len(data):
        begin = at if data.startswith(b"WARC/", at) else data.find(b"\nWARC/", at) + 1 or len(data)
        if data[at:begin].strip():
            yield [], data[at:begin], "not a WARC record"
        if begin == len(data):
            return
        head = HEAD.search(data, begin)
        if not head:
            yield [], data[begin:], "cut short"
            return
        headers, size = fields(data[begin : head.start()], "utf-8"), 0
        stated = value(headers, "Content-Length", "")
        at = head.end()
        if not re.fullmatch(r"[0-9]+", stated):
            yield headers, b"", "no valid length"
            at = data.find(b"\nWARC/", at) + 1 or len(data)
            continue
        size = int(stated)
        block = data[at : at + size]
        if len(block) < size:
            at = data.find(b"\nWARC/", at) + 1 or len(data)
            yield headers, block[: at - head.end()], "cut short"
            continue
        yield headers, block, None
        at += size
        at += re.compile(rb"[\r\n]*").match(data, at).end() - at


def response(page_id: int | None, url: str | None, body: str | None, date: str = EPOCH) -> bytes:
    """The response record of a fetched page."""
    payload = (body or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = {"WARC-Record-ID": name("response", str(page_id), url or "", digest(payload)), "WARC-Target-URI": url or "", "WARC-Date": date, "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response"}
    return record("response", headers, block)


def unchunked(body: bytes) -> bytes:
    """The data of chunks. A size that isn't of hexadecimal digits raises ValueError; what is cut short is taken as far as it goes."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        stated = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", stated):
            raise ValueError("no chunk size")
        if not (size := int(stated, 16)):
            break
        out.append(body[end + 1 : end + 1 + size])
        at = end + 1 + size + (2 if body[end + 1 + size : end + 3 + size] == b"\r\n" else 1)
    return b"".join(out)


def decoded(payload: bytes, coding: str) -> bytes:
    """The payload without one content coding; of zstd and deflate too. Raises LookupError for a coding that isn't known, ValueError or zlib.error if it doesn't hold."""
    if coding in ("", "identity"):
        return payload
    if coding in ("gzip", "x-gzip"):
        return zlib.decompress(payload, 47)
    if coding == "deflate":
        return zlib.decompress(payload) if payload[:1] == b"\x78" else zlib.decompress(payload, -15)
    if coding == "zstd":
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(payload)
        except zstandard.ZstdError as e:
            raise ValueError(str(e)) from e
    raise LookupError(f"content coding {coding} is not known")


def http(block: bytes) -> tuple[str, Headers, bytes, bytes]:
    """(status line, headers, body as sent, payload) of a response's block. Codings that don't hold are left as they are, unknown ones raise LookupError."""
    end = HEAD.search(block)
    head, body = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    status, headers, payload = head.split(b"\n", 1)[0], fields(head, "latin-1"), body
    try:
        if "chunked" in value(headers, "Transfer-Encoding", "").lower():
            payload = unchunked(payload)
        for coding in reversed(value(headers, "Content-Encoding", "").lower().replace(" ", "").split(",")):
            payload = decoded(payload, coding)
    except (ValueError, zlib.error):
        payload = body
    return status.decode("latin-1").strip(), headers, body, payload


def charset(headers: Headers, payload: bytes) -> str:
    """The encoding that the headers or the page's first 1,024 bytes state, else UTF-8."""
    stated = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", value(headers, "Content-Type", ""), re.I) or re.search(r"<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)", payload[:1024].decode("latin-1"), re.I)
    try:
        return codecs.lookup(stated[1]).name if stated else "utf-8"
    except LookupError:
        return "utf-8"


def digest_holds(stated: str | None, *data: bytes, known: str | None = None) -> bool:
    """Whether a stated digest is that of one of the data (known: the first one's digest()); none, or one of an unknown algorithm, is taken as it is."""
    name_, _, told = (stated or "").partition(":")
    if name_.lower() not in ("sha1", "sha256", "md5") or stated == known:
        return True
    found = [hashlib.new(name_.lower(), x).digest() for x in data]
    return any(told.lower() == x.hex() or told.upper().rstrip("=") == base64.b32encode(x).decode().rstrip("=") for x in found)


def opened(page: str) -> str:
    """The page without comments and what scripts and the like hold; their opening tags stay. A < that no > follows is text."""
    page = HIDDEN.sub(lambda m: m[0][: m[0].find(">") + 1] if m[1] else " ", page)
    last = page.rfind(">") + 1
    return page[:last] + page[last:].replace("<", "&lt;")


def plain(page: str) -> str:
    """The text of an opened() HTML page but its titles, a line for each block of it. A title that isn't closed ends with the head."""
    page = TITLE.sub(" ", page)
    page = html.unescape(TAG.sub("", BREAK.sub("\n", page.replace("\n", " "))))
    return LINES.sub("\n", BLANK.sub(" ", page)).strip()


def links(page: str, base: str) -> list[dict[str, str]]:
    """Tag, attribute and absolute target of each link of an opened() page."""
    found = []
    origin = re.match(r"https?://[^/?#\s\[\]]+", base)
    for tag, attributes in LINK.findall(page):
        for attribute, a, b, c in TARGET.findall(attributes):
            url = html.unescape(a or b or c).strip()
            if url.startswith("/") and origin and PLAIN_PATH.fullmatch(url):
                url = origin[0] + url
            elif not PLAIN_URL.fullmatch(url):
                try:
                    url = urljoin(base, url)
                except ValueError:
                    pass
            found.append({"path": f"{tag.upper()}@/{attribute.lower()}", "url": url})
    return found


def derive(headers: Headers, block: bytes) -> tuple[list[bytes], dict, bool]:
    """(the metadata and conversion records of a response record, title and links, whether the digests that it states hold)."""
    status, told, body, payload = http(block)
    try:
        page = opened(payload.decode(charset(told, payload), "replace"))
    except (LookupError, ValueError):  # a codec that isn't one of texts
        page = opened(payload.decode("utf-8", "replace"))
    sent, first = digest(body), {k.lower(): v for k, v in reversed(headers)}
    source, uri, stated = (first.get(k, "") for k in ("warc-record-id", "warc-target-uri", "warc-payload-digest"))
    ok = digest_holds(first.get("warc-block-digest"), block) and digest_holds(stated, body, payload, known=sent)
    title = TITLE.search(page)
    found = {"Title": line(html.unescape(TAG.sub("", title[1]))) if title else None, "Links": links(page, uri)}
    envelope = {"WARC-Header": headers, "HTTP-Response": {"Status": status, "Headers": told}, "Payload-Digest": sent if payload is body else digest(payload), "HTML": found}
    common = {"WARC-Refers-To": source, "WARC-Target-URI": uri, "WARC-Date": first.get("warc-date", EPOCH), "WARC-Source-Payload-Digest": stated or sent}
    out = []
    for kind, content, made in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", plain(page).encode("utf-8", "replace"))):
        own = digest(made)
        out.append(record(kind, {"WARC-Record-ID": name(kind, source)} | common | {"WARC-Payload-Digest": own, "Content-Type": content}, made, own))
    return out, found, ok


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """(page_id, record): the response record of each row of pages (page_id, url, html; further columns don't matter).

    A null url leaves the record without a target; a null html has no payload.
    Repeated rows give the same record again.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [response(*x, date) for x in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, record binary")


def whole(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records of pieces of a file that was split before each `WARC/1.` after an empty line: pieces are joined again until the length that the record states is reached."""
    held, size, wants = [], 0, 0

    def out() -> bytes:
        data = b"".join(held)
        return data if not wants or data[wants:].strip(b"\r\n") else data[:wants] + b"\r\n\r\n"  # one empty line at a file's end too

    for piece in pieces:
        if held and size >= wants:
            yield out()
            held, size = [], 0
        if not held:
            head = HEAD.search(piece)
            stated = value(fields(piece[: head.start()], "utf-8"), "Content-Length", "") if head else ""
            wants = head.end() + int(stated) if re.fullmatch(r"[0-9]{1,18}", stated) else 0
        held.append(piece)
        size += len(piece)
    if held:
        yield out()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record) of the records of all WARC files (.warc or .warc.gz) under path; page_id is null.

    Files are split at the lines that begin records, so that a large one is read
    by many tasks (a compressed one by one, as a stream). Where a payload holds
    such a line after an empty one, what follows it in the same split of the file
    is joined to it again; where a split of the file ends just there, derivatives()
    reports a record that is cut short. Files without \\r before their line ends
    come as one row for each split.
    """
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def own(group: Iterator[tuple]) -> Iterator[bytes]:
            for k, (*_, data) in enumerate(group):
                if data:
                    yield (data if not k and data.startswith(b"WARC/") else b"WARC/1." + data) + b"\r\n\r\n"

        for _, group in groupby(rows(), key=lambda row: row[:2]):
            for data in whole(own(group)):
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([data], pa.binary())], ["page_id", "record"])

    rows = spark.read.option("lineSep", "\r\n\r\nWARC/1.").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")).mapInArrow(run, "page_id long, record binary")


FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "source_digest": "WARC-Source-Payload-Digest"}


def derivatives(records: DataFrame, compress: bool = False) -> DataFrame:
    """Two rows for each response among records (page_id, record): the FIELDS of a derivative record, its content_length, source_headers (a JSON list of names and values), title and links of the source, text (of a conversion), digest_ok, error and record, its bytes.

    Records of other types give nothing; a null record gives nothing. A malformed
    record, or a response of an unknown content coding, gives one row with its
    page_id, source_headers and error alone. The
    fields are those read back from the record's bytes. digest_ok: the source's
    block and payload (as sent or decoded) have the digests that its headers
    state. An empty payload has an empty conversion. Pages of any length are
    converted whole; repeated rows give the same records again. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for page_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for headers, block, error in parse(data or b""):
                    stated = json.dumps(headers, ensure_ascii=False)
                    if error:
                        out.append({"page_id": page_id, "source_headers": stated, "error": error})
                    if error or value(headers, "WARC-Type", "").lower() != "response":
                        continue
                    try:
                        records_, found, ok = derive(headers, block)
                    except LookupError as e:
                        out.append({"page_id": page_id, "source_headers": stated, "error": str(e.args[0])})
                        continue
                    for made in records_:
                        [(told, text, _)] = parse(made)
                        told = {k.lower(): v for k, v in reversed(told)}
                        row = {k: told.get(v.lower()) for k, v in FIELDS.items()}
                        meta = found if row["record_type"] == "metadata" else {}
                        row |= {"page_id": page_id, "content_length": len(text), "source_headers": stated, "title": meta.get("Title"), "links": [x["url"] for x in meta.get("Links", [])], "text": None if meta else text.decode(), "digest_ok": ok}
                        out.append(row | {"record": gzip.compress(made, 6, mtime=0) if compress else made})
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    prepare(records.sparkSession)
    return records.select("page_id", "record").mapInArrow(run, ", ".join(f"{f.name} {KINDS[f.type]}" for f in SCHEMA))


SCHEMA = pa.schema([("page_id", pa.int64()), *((k, pa.string()) for k in FIELDS), ("content_length", pa.int64()), ("source_headers", pa.string()), ("title", pa.string()), ("links", pa.list_(pa.string())), ("text", pa.string()), ("digest_ok", pa.bool_()), ("error", pa.string()), ("record", pa.binary())])
KINDS = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.bool_(): "boolean", pa.binary(): "binary"}
