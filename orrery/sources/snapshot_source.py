"""Data source `world_snapshot`: the elements of nested XML files, read as streams by the tasks.

    spark.dataSource.register(SnapshotSource)
    spark.read.format("world_snapshot").option("path", folder).load()

Options: path (a file or a folder, searched through), tags (comma-separated: only
these elements), until (stop behind the first such element, as for a header),
suffixes (comma-separated, of the files to read).
A file is in one partition, which small ones share; the driver lists names and
sizes alone. A folder of saves is recognised by saves().
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .snapshot_xml import ELEMENT, batches

SUFFIXES = (".xml", ".xml.gz")
SCHEMES = ("file", "hdfs", "s3", "gs")
#: Bytes of files that share a partition; a packed byte counts as ten.
SHARE, PACKED = 1 << 22, 10


def readable(path: str) -> bool:
    """Whether tasks can open files under a path: it has no scheme, or one of a file system that they know."""
    scheme = re.match(r"([a-zA-Z][\w+.-]*):", path)
    return scheme is None or scheme[1].lower() in SCHEMES


def system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffixes: Sequence[str] = SUFFIXES) -> list[tuple[str, float | None, int]]:
    """(path, time of change, bytes) of the snapshot files at or under a path, in order."""
    from pyarrow import fs

    store, own = system(path)
    found = store.get_file_info(own)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    rest = store.get_file_info(fs.FileSelector(own, recursive=True)) if found.type == fs.FileType.Directory else [found]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + x.path, x.mtime.timestamp() if x.mtime else None, x.size or 0) for x in rest if x.type == fs.FileType.File and x.path.endswith(tuple(suffixes)))


def saves(roots: Sequence[str]) -> list[str]:
    """The save files of the first root that has any, the newest first: <profile number>/save/<name> below it, of any depth.

    A save that is being written (a file called temp beside it) makes this fail,
    as it can't be told from a whole one.
    """
    for root in roots:
        try:
            files = listed(root)
        except FileNotFoundError:
            continue
        own = [(t or 0.0, p) for p, t, _ in files if re.search(r"/[0-9]+/save/[^/]+$", p)]
        if own:
            busy = [p for _, p in own if p.rsplit("/", 1)[1].split(".")[0].lower() == "temp"]
            if busy:
                raise RuntimeError(f"{busy[0]} is being written")
            return [p for _, p in sorted(own, key=lambda x: (-x[0], x[1]))]
    return []


@dataclass
class Files(InputPartition):
    paths: list[str]


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.until = options["path"], options.get("until")
        self.suffixes = options["suffixes"].split(",") if options.get("suffixes") else SUFFIXES
        self.tags = frozenset(x.strip() for x in options["tags"].split(",")) if options.get("tags") else None

    def partitions(self) -> Sequence[InputPartition]:
        out, room = [], 0
        for path, _, size in listed(self.path, self.suffixes):
            size *= PACKED if path.endswith(".gz") else 1
            if not out or size > room:
                out.append(Files([]))
                room = SHARE
            out[-1].paths.append(path)
            room -= size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            store, own = system(path)
            with store.open_input_stream(own, compression=None) as stream:
                yield from batches(path, stream, self.tags, self.until)


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "world_snapshot"

    def schema(self) -> str:
        return ELEMENT

    def reader(self, schema) -> SnapshotReader:
        if "path" not in self.options:
            raise ValueError("the option path is missing")
        return SnapshotReader(self.options)
