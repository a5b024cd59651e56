"""A streaming source of captured bytes: datagrams and connections as a collector writes them, framed into lines.

A capture is a file that may still grow, in a folder that the driver and all executors can open. Its name tells what it holds and from
whom: `<host>_<port>.udp` has datagrams, each with its length before it as four bytes, big-endian; `<host>_<port>.tcp` has the
bytes of a connection, with lines that end in a line feed. A datagram is one line, whatever it holds, cut to max_bytes, its bytes that are
no UTF-8 becoming U+FFFD; of a connection, lines that are longer or no UTF-8 are dropped, and a carriage return before the line
feed. Empty lines are dropped.

The offset is the number of bytes of each file that are framed, always at a frame's end, so that a replay or a restart gives the same
lines. A connection's last line without a line feed comes once a file of its name with the suffix `.eof` is there.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, source_ip string, received_at timestamp, transport string"
#: Bytes read at a time in search of a line's end.
_BLOCK = 1 << 16


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def source_of(path: str) -> str:
    host, _, port = os.path.basename(path).rpartition(".")[0].rpartition("_")
    return f"[{host}]:{port}" if ":" in host else f"{host}:{port}"


def last_datagram(path: str, start: int, size: int) -> int:
    """Where the last whole datagram from start ends, in a file of size bytes."""
    with open(path, "rb") as f:
        while start + 4 <= size:
            f.seek(start)
            end = start + 4 + int.from_bytes(f.read(4), "big")
            if end > size:
                break
            start = end
    return start


def last_line(path: str, start: int, size: int) -> int:
    """Where the last whole line from start ends; at the file's end if it is known to be the last."""
    if os.path.exists(f"{path}.eof"):
        return size
    with open(path, "rb") as f:
        at = size
        while at > start:
            low = max(start, at - _BLOCK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


def datagrams(path: str, start: int, end: int, max_bytes: int) -> Iterator[str]:
    with open(path, "rb") as f:
        f.seek(start)
        while f.tell() < end:
            yield f.read(int.from_bytes(f.read(4), "big"))[:max_bytes].decode("utf-8", "replace")


def lines(path: str, start: int, end: int, max_bytes: int) -> Iterator[str]:
    """A line longer than max_bytes is passed over block by block, so that no task holds one whole."""
    with open(path, "rb") as f:
        f.seek(start)
        skipping = False
        while f.tell() < end:
            part = f.readline(min(max_bytes + 2, end - f.tell()))
            whole = part.endswith(b"\n") or f.tell() >= end
            body = part.removesuffix(b"\n").removesuffix(b"\r") if part.endswith(b"\n") else part
            if whole and not skipping and len(body) <= max_bytes:
                with contextlib.suppress(UnicodeDecodeError):
                    yield body.decode("utf-8")
            skipping = not whole


class CaptureReader(DataSourceStreamReader):
    def __init__(self, folder: str, max_bytes: int):
        self.folder, self.max_bytes = folder, max_bytes
        self.framed: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """How far each file is framed: whole frames only. What was found before saves a walk, but nothing hangs on it."""
        for name in sorted(os.listdir(self.folder)):
            path, start, kind = os.path.join(self.folder, name), self.framed.get(name, 0), name.rpartition(".")[2]
            if kind in ("udp", "tcp"):
                self.framed[name] = (last_datagram if kind == "udp" else last_line)(path, start, os.path.getsize(path))
        return dict(self.framed)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(os.path.join(self.folder, n), start.get(n, 0), e) for n, e in sorted(end.items()) if e > start.get(n, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        kind, source = partition.path.rpartition(".")[2], source_of(partition.path)
        now = datetime.fromtimestamp(os.path.getmtime(partition.path), UTC)
        for value in (datagrams if kind == "udp" else lines)(partition.path, partition.start, partition.end, self.max_bytes):
            if value:
                yield value, source, now, kind

    def commit(self, end: dict) -> None:
        pass


class Captures(DataSource):
    """spark.readStream.format("captures").option("path", folder), with max_bytes if asked."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("max_bytes", 8192)))


def read_captures(spark: SparkSession, folder: str, max_bytes: int = 8192) -> DataFrame:
    """The lines of a folder of captures, as a stream that ingest() takes."""
    spark.dataSource.register(Captures)
    return spark.readStream.format("captures").option("path", folder).option("max_bytes", max_bytes).load().drop("transport")
