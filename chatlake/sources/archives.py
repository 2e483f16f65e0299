"""A data source for chat archives: a folder or ZIP files of JSON arrays, read element by element.

Each JSON file or ZIP member is a partition of its own. Its bytes stream through a splitter that holds one element and a piece
of the file, so an export of any size is read in bounded memory; a row is one element (a conversation), never a whole file.
Files are opened by path, so the path must be one that all executors share.

What is refused, before anything is read: member names that leave the root, links in archives, links of a folder that lead out
of it, more members or bytes than the limits, and members that unpack to a suspicious multiple of their size.
"""

from __future__ import annotations

import os
import re
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chatlake.sources.exports import LIMITS, ArchiveRejected, check_member

#: Bytes read at a time, and bytes of elements handed on in a batch.
CHUNK, BATCH = 1 << 20, 4 << 20
#: Strings as a whole, structural marks, and a quote whose string doesn't end in what has been read.
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{},]|"', re.S)
_SCHEMA = pa.schema([("file", pa.string()), ("place", pa.int64()), ("value", pa.string())])


def elements(stream, key: bytes = b"conversations", chunk: int = CHUNK) -> Iterator[bytes]:
    """The elements of a JSON array, or of the array under a key of a JSON object, one after the other.

    stream has read(n). Anything else holds no elements; JSON that breaks off is an error. Memory: an element and a piece.
    """
    buf, at, start, depth, goal, named, size = b"", 0, None, 0, None, None, chunk
    first, ended = True, False
    while True:
        more = stream.read(size)
        buf = buf[start if start is not None else at :] + more
        at, start = (at - start, 0) if start is not None else (0, None)
        if first:
            buf, first = buf.removeprefix(b"\xef\xbb\xbf"), False
        scanned = at
        for m in _TOKEN.finditer(buf, at):
            token, where = m[0], m.start()
            if token == b'"':
                scanned = where
                break
            scanned = m.end()
            if token[:1] == b'"':
                named = token[1:-1] if depth == 1 else named
            elif token in b"[{":
                depth += 1
                if goal is None and token == b"[" and (depth == 1 or depth == 2 and named == key and not ended):
                    goal, start = depth, scanned
            elif token in b"]}":
                if depth == goal:
                    if value := buf[start:where].strip():
                        yield value
                    goal, start, ended = None, None, True
                depth -= 1
            elif depth == goal:
                if value := buf[start:where].strip():
                    yield value
                start = scanned
        else:
            scanned = len(buf)
        size = min(size * 2, 64 << 20) if scanned == at and more else chunk  # a long string: not searched again for every piece
        at = scanned
        if not more:
            if depth:
                raise ArchiveRejected("the JSON breaks off")
            return


@dataclass
class Member(InputPartition):
    path: str
    member: str | None
    bytes: int


def members(path: str, limits: dict[str, int] | None = None) -> list[Member]:
    """The JSON members of a ZIP file, or of a folder's files and the ZIP files among them, all checked."""
    limits, found = LIMITS | (limits or {}), []
    files = [path]
    if os.path.isdir(path):
        root = os.path.realpath(path)
        files = sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)
        for f in files:
            if not os.path.realpath(f).startswith(root + os.sep):
                raise ArchiveRejected(f"{f!r} leads out of the folder")
    for f in files:
        if zipfile.is_zipfile(f):
            with zipfile.ZipFile(f) as z:
                for i in (i for i in z.infolist() if not i.is_dir()):
                    check_member(i.filename)
                    if i.create_system == 3 and stat.S_ISLNK(i.external_attr >> 16):
                        raise ArchiveRejected(f"{i.filename!r} is a link")
                    if i.compress_size and i.file_size > limits["ratio"] * i.compress_size:
                        raise ArchiveRejected(f"{i.filename!r} is too large unpacked")
                    found.append(Member(f, i.filename, i.file_size))
        else:
            found.append(Member(f, None, os.path.getsize(f)))
    if len(found) > limits["members"] or sum(m.bytes for m in found) > limits["total_bytes"]:
        raise ArchiveRejected("too many or too large members")
    return [m for m in found if (m.member or m.path).lower().endswith(".json")]


class _Reader(DataSourceReader):
    def __init__(self, path: str, limits: dict[str, int]):
        self.path, self.limits = path, limits

    def partitions(self) -> list[Member]:
        return members(self.path, self.limits) or [Member("", None, 0)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        name = f"{partition.path}!{partition.member}" if partition.member else partition.path
        held, size, place = [], 0, 0

        def batch() -> pa.RecordBatch:
            places = range(place - len(held), place)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(places, pa.int64()), pa.array(held)], schema=_SCHEMA)

        archive = zipfile.ZipFile(partition.path) if partition.member else None
        try:
            with archive.open(partition.member) if archive else open(partition.path, "rb") as stream:
                for value in elements(stream):
                    held.append(value.decode("utf-8", "replace"))
                    size, place = size + len(value), place + 1
                    if size >= BATCH:
                        yield batch()
                        held, size = [], 0
            if held:
                yield batch()
        finally:
            if archive:
                archive.close()


class ChatArchive(DataSource):
    """Options: path; members, total_bytes and ratio as limits. Rows: file, place and value (an element's JSON)."""

    @classmethod
    def name(cls) -> str:
        return "chat_archive"

    def schema(self) -> str:
        return "file string, place long, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(re.sub(r"^file:(//)?(?=/)", "", self.options["path"]), {k: int(self.options[k]) for k in LIMITS if k in self.options})


def archive_elements(spark: SparkSession, path: str, limits: dict[str, int] | None = None) -> DataFrame:
    """file, place and value of the elements of all JSON members; chat_export() takes them as its members."""
    spark.dataSource.register(ChatArchive)
    return spark.read.format("chat_archive").options(**{k: str(v) for k, v in (limits or {}).items()}).load(path)
