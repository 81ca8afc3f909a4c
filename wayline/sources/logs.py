"""Growing log files as a data source: byte ranges cut at line ends, for batch reads and for streams that resume.

``spark.read.format("growing_logs")`` and ``spark.readStream.format("growing_logs")`` give path (below the root), start,
content and size (of the file when it was listed). Options: path, the root; glob, of file names; step, the bytes of a
range. A task reads one range, or several smaller ones of up to so many bytes together. A stream's offset tells for each file how far it was read, always up to a line's end, so that a
restart goes on at that byte, and what is appended later is read then. A file that got shorter, or whose first bytes
are others, is a new one and read from its start.

Files are listed and read through Arrow's file systems: local or mounted paths, and URIs that Arrow knows. Symbolic links
of local folders are not followed. A range whose file has gone meanwhile gives no rows.
"""

from __future__ import annotations

import fnmatch
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "growing_logs"
SCHEMA = "path string, start bigint, content binary, size bigint"
STEP, HEAD = 2 << 20, 64
#: No frame is longer than this: where no line ends within it, a cut parts no frame.
LINE = 8192


@dataclass
class Bytes(InputPartition):
    """What a task reads: from start to stop, both moved to the next line's start unless they are a range's own ends."""

    path: str
    start: int
    stop: int
    size: int
    first: bool
    last: bool


@dataclass
class Pack(InputPartition):
    """What one task reads: ranges of one or more files, as small files would else cost a task each."""

    ranges: list[Bytes]


def packed(ranges: list[Bytes], step: int) -> list[Pack]:
    """The ranges in their order, in packs of at most step bytes or of one range."""
    out, held = [], 0
    for r in ranges:
        n = r.stop - r.start
        if not out or held + n > step:
            out.append(Pack([]))
            held = 0
        out[-1].ranges.append(r)
        held += n
    return out


class Folder:
    """The log files below a root."""

    def __init__(self, root: str, glob: str = "*.log", step: int = STEP):
        self.glob, self.step = glob, step
        plain = root.removeprefix("file://") if root.startswith("file:///") else root.removeprefix("file:") if root.startswith("file:/") else root
        self.local = "://" not in plain
        self.files, self.root = (fs.LocalFileSystem(), os.path.abspath(plain)) if self.local else fs.FileSystem.from_uri(plain)

    def sizes(self) -> dict[str, int]:
        """Size by path below the root."""
        found = self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        out = {}
        for x in found:
            name = x.path[len(self.root) :].lstrip("/")
            if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob) and not (self.local and self._linked(name)):
                out[name] = x.size
        return out

    def _linked(self, name: str) -> bool:
        at = self.root
        for part in name.split("/"):
            at = f"{at}/{part}"
            if os.path.islink(at):
                return True
        return False

    def bytes(self, name: str, start: int, n: int) -> bytes:
        with self.files.open_input_file(f"{self.root}/{name}") as f:
            f.seek(start)
            return f.read(n)

    def whole_lines(self, name: str, size: int) -> int:
        """Where the last line that has ended ends."""
        at = max(0, size - LINE)
        ended = self.bytes(name, at, size - at).rfind(b"\n") + 1
        return at + ended if ended else at

    def head(self, name: str, n: int) -> int:
        return zlib.crc32(self.bytes(name, 0, n))

    def ranges(self, name: str, start: int, stop: int, size: int) -> list[Bytes]:
        cuts = [*range(start, stop, self.step), stop]
        return [Bytes(name, a, b, size, a == start, b == stop) for a, b in zip(cuts, cuts[1:])]

    def read(self, part: Bytes | Pack) -> Iterator[tuple]:
        if isinstance(part, Pack):
            for r in part.ranges:
                yield from self.read(r)
            return
        try:
            data = self.bytes(part.path, max(0, part.start - 1), part.stop + LINE - max(0, part.start - 1))
        except FileNotFoundError:
            return
        base = max(0, part.start - 1)
        start = part.start if part.first else _line_start(data, base, part.start, part.size)
        stop = part.stop if part.last else _line_start(data, base, part.stop, part.size)
        if stop > start:
            yield part.path, start, data[start - base : stop - base], part.size


def _line_start(data: bytes, base: int, at: int, size: int) -> int:
    """The start of the first line at or after a byte; the byte itself where no line ends near."""
    found = data.find(b"\n", at - 1 - base, at - 1 - base + LINE)
    return min(size, base + found + 1) if found >= 0 else at


class LogReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Pack]:
        return packed([r for name, size in sorted(self.folder.sizes().items()) for r in self.folder.ranges(name, 0, size, size)], self.folder.step)

    def read(self, partition: Pack) -> Iterator[tuple]:
        return self.folder.read(partition)


class LogStream(DataSourceStreamReader):
    """Offsets are {path: [end, length of the head, checksum of the head]}."""

    def __init__(self, folder: Folder):
        self.folder, self.known = folder, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {}
        for name, size in self.folder.sizes().items():
            if name in self.known and self.known[name][0] == size:
                now[name] = self.known[name]
                continue
            try:
                end = self.folder.whole_lines(name, size)
                n = min(HEAD, end)
                now[name] = (size, [end, n, self.folder.head(name, n)])
            except FileNotFoundError:
                continue
        self.known = now
        return {name: entry for name, (_, entry) in sorted(now.items())}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        out = []
        for name, entry in end.items():
            if entry != (before := start.get(name)):
                out += self.folder.ranges(name, self._goes_on(name, before, entry), entry[0], entry[0])
        return packed(out, self.folder.step)

    def _goes_on(self, name: str, before: list | None, now: list) -> int:
        try:
            same = before is not None and before[0] <= now[0] and self.folder.head(name, before[1]) == before[2]
        except FileNotFoundError:
            same = False
        return before[0] if same else 0

    def read(self, partition: Pack) -> Iterator[tuple]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> Folder:
        return Folder(self.options["path"], self.options.get("glob", "*.log"), int(self.options.get("step", STEP)))

    def reader(self, schema) -> LogReader:
        return LogReader(self._folder())

    def streamReader(self, schema) -> LogStream:
        return LogStream(self._folder())


def growing_logs(spark: SparkSession, path: str, glob: str = "*.log", step: int = STEP, stream: bool = False):
    """The log files under path as byte ranges, once or as a stream."""
    spark.dataSource.register(GrowingLogs)
    return (spark.readStream if stream else spark.read).format(NAME).option("path", path).option("glob", glob).option("step", step).load()
