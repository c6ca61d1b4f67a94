"""A media column: payloads kept as lossless WebP images, and pixel arrays read back from them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import prepare

ROW = 64
#: Bytes of payload in one image: the highest that the format has.
IMAGE = ROW * 16_384


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def store(payload: bytes) -> bytes:
    """The payload as grey 8-bit samples, 64 to a row, in one WebP file for each IMAGE bytes, one behind the other, each with the transforms, references and cache that webp.chosen() finds for it."""
    out = []
    for k in range(0, len(payload), IMAGE):
        part = np.frombuffer(payload[k : k + IMAGE], np.uint8).reshape(-1, ROW)
        out.append(webp.encode(webp.grey(part), **webp.chosen(part)))
    return b"".join(out)


def pixels(media: bytes) -> list[np.ndarray]:
    """The samples (height, width) of each image."""
    out, k = [], 0
    while k < len(media):
        size = 8 + int.from_bytes(media[k + 4 : k + 8], "little")
        out.append(((webp.decode(media[k : k + size]) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8))
        k += size
    return out


def feature(images: list[np.ndarray]) -> str:
    """Shape, mean, distinct samples, share of repeats of the sample before, and the means of eight bands of rows."""
    flat = np.concatenate([x.ravel() for x in images])
    counts = np.bincount(flat, minlength=256)
    bands = [int(x.sum(dtype=np.int64) * 100 // max(x.size, 1)) for x in np.array_split(flat, 8)]
    same = int((flat[1:] == flat[:-1]).sum())
    return f"{'+'.join('x'.join(map(str, x.shape[::-1])) for x in images)};mean={int((counts * np.arange(256)).sum()) * 100 // flat.size};distinct={int((counts > 0).sum())};same={same};bands={','.join(map(str, bands))}"


def images(docs: DataFrame, with_media: bool = False, with_pixels: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row of docs (doc_id, text; further columns don't matter).

    A text's payload is its UTF-8 bytes (null: none) and zeros up to a positive
    multiple of 64. Payload columns and the feature come from the image that was
    read back. with_media adds media, the WebP bytes; with_pixels adds pixels, the
    rows of samples of all images. Equal texts give equal values; equal rows
    are returned as often as they come. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if with_media:
        schema, kinds = schema.append(pa.field("media", pa.binary())), f"{kinds}, media binary"
    if with_pixels:
        schema, kinds = schema.append(pa.field("pixels", pa.list_(pa.binary()))), f"{kinds}, pixels array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                media = store(payload := padded(data))
                read = pixels(media)
                back = b"".join(x.tobytes() for x in read)[: len(payload)]
                row = [doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(read)]
                out.append(row + [media] * with_media + [[r.tobytes() for x in read for r in x]] * with_pixels)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)
