"""A data source of lines appended to files in place: batch and streaming, each line with its file and place."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, line_no long, value string"
#: Bytes read at once; and bytes of one file in one partition, cut at line ends.
BLOCK = 1 << 20
SPAN = 64 << 20
#: Bytes before an offset that tell whether the file is still the one read: more than the 64 of the reference, as lines may end alike.
TAIL = 4096


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


def jsonl_files(roots: list[str]) -> Iterator[str]:
    """*.jsonl below the roots, hidden ones included; linked directories aren't followed."""
    for root in roots:
        if os.path.isfile(root):
            yield root
        for folder, inner, names in os.walk(root):
            inner.sort()
            for name in sorted(names):
                if name.endswith(".jsonl"):
                    yield os.path.join(folder, name)


def last_line_end(path: str, size: int) -> int:
    """The place after the last newline before size: what is behind it may still be written."""
    with open(path, "rb") as f:
        at = size
        while at:
            begin = max(0, at - BLOCK)
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            at = begin
    return 0


def lines_of(piece: Piece) -> Iterator[tuple[str, int, str]]:
    """Lines that begin in [start, end), each with the byte it begins at; invalid UTF-8 is replaced."""
    with open(piece.path, "rb") as f:
        at = piece.start
        if at:
            f.seek(at - 1)
            if f.read(1) != b"\n":  # the piece before has this line
                at += len(f.readline())
        f.seek(at)
        while at < piece.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield piece.path, at, line.rstrip(b"\n").rstrip(b"\r").decode("utf-8", "replace")
            at += len(line)


def pieces(path: str, start: int, end: int) -> list[Piece]:
    return [Piece(path, a, min(end, a + SPAN)) for a in range(start, end, SPAN)]


class _Batch(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self):
        return [p for path in jsonl_files(self.roots) for p in pieces(path, 0, last_line_end(path, os.stat(path).st_size))]

    def read(self, partition):
        yield from lines_of(partition)


def tail_hash(path: str, place: int) -> str:
    """A hash of the TAIL bytes before a place: another one tells that the file was rewritten."""
    with open(path, "rb") as f:
        begin = max(0, place - TAIL)
        f.seek(begin)
        return hashlib.blake2b(f.read(place - begin), digest_size=8).hexdigest()


def rewritten(path: str, place: int, tail: str) -> bool:
    try:
        return tail_hash(path, place) != tail
    except FileNotFoundError:
        return False


class _Stream(DataSourceStreamReader):
    """Offsets: file to [inode, place after the last complete line, hash of the bytes before it].

    A file that shrank, was put in place anew, or was rewritten in place (other bytes before the last place) is read from its start.
    """

    def __init__(self, roots: list[str]):
        self.roots, self.known = roots, {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        out = {}
        for path in jsonl_files(self.roots):
            try:
                at = os.stat(path)
                was = self.known.get(path)
                if was and was[0] == (at.st_ino, at.st_size, at.st_mtime_ns):
                    out[path] = was[1]
                    continue
                place = last_line_end(path, at.st_size)
                out[path] = [at.st_ino, place, tail_hash(path, place)]
                self.known[path] = ((at.st_ino, at.st_size, at.st_mtime_ns), out[path])
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start, end):
        out = []
        for path, (inode, place, *tail) in sorted(end.items()):
            node, begin, *was = start.get(path, (inode, 0))  # offsets of older checkpoints have no hash
            if [node, begin, *was] == [inode, place, *tail]:
                continue
            kept = node == inode and begin <= place and not (was and rewritten(path, begin, was[0]))
            out += pieces(path, begin if kept else 0, place)
        return out or [Piece(os.devnull, 0, 0)]

    def read(self, partition):
        yield from lines_of(partition)


class AppendedLines(DataSource):
    """format("appended_lines").option("path", "a,b"): folders that every executor sees."""

    @classmethod
    def name(cls):
        return "appended_lines"

    def schema(self):
        return SCHEMA

    def _roots(self) -> list[str]:
        return [p.removeprefix("file://").removeprefix("file:") for p in self.options["path"].split(",") if p]

    def reader(self, schema):
        return _Batch(self._roots())

    def streamReader(self, schema):
        return _Stream(self._roots())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendedLines)
