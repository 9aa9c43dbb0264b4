"""Files followed from their end: byte offsets by path, rotation by inode, truncation by size.

The offset of the stream is `{path: [inode, position]}`. A file whose inode changed or that got shorter is read from its
beginning. A batch takes at most `maxBytes`, cut into byte ranges of `taskBytes`; the driver only looks for line ends, the tasks
read the lines, so they must see the files under the same paths. A last line without line end is held back until it is ended, or
until the file has been quiet for `quietSeconds`, so that a line that is still being written isn't cut in two.
"""

from __future__ import annotations

import glob
import os
import time
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .network import LINES

BLOCK = 1 << 16


def expand(patterns: list[str]) -> list[str]:
    """The files that the patterns match, sorted, each once."""
    return sorted({os.path.realpath(f) for p in patterns for f in glob.glob(p) if os.path.isfile(f)})


def where_to_start(path: str, known: list[int] | None, tail: bool) -> tuple[int, int]:
    """(inode, position) from which to read: known position, or 0 after rotation or truncation, or the end of a new file to tail."""
    st = os.stat(path)
    if known is None:
        return st.st_ino, st.st_size if tail else 0
    inode, position = known
    return st.st_ino, position if inode == st.st_ino and position <= st.st_size else 0


def last_break(path: str, start: int, stop: int) -> int:
    """The position after the last line end between two positions, read backwards from the second; the first if there is none."""
    with open(path, "rb") as f:
        while stop > start:
            at = max(start, stop - BLOCK)
            f.seek(at)
            cut = f.read(stop - at).rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            stop = at
    return start


def next_break(path: str, start: int, stop: int) -> int:
    """The position after the first line end between two positions; the first if there is none."""
    with open(path, "rb") as f:
        f.seek(start)
        at = start
        while at < stop and (block := f.read(min(BLOCK, stop - at))):
            cut = block.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(block)
    return start


def lines_between(path: str, first: int, last: int, start: int, end: int) -> Iterator[str]:
    """Of the range from `first` to `last`, the lines that begin from `start` to before `end`, without trailing blanks and blank lines."""
    with open(path, "rb") as f:
        at = start
        if start > first:
            f.seek(start - 1)
            at = start - 1 + len(f.readline(last - start + 1))
        f.seek(at)
        while at < end and (raw := f.readline(last - at)):
            at += len(raw)
            if line := raw.decode("utf-8", "replace").rstrip():
                yield line


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, start: int, end: int) -> None:
        self.path, self.first, self.last, self.start, self.end = path, first, last, start, end


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.patterns = [p for p in options.get("paths", "").split(",") if p]
        self.tail = options.get("tail", "true").lower() == "true"
        self.max_bytes, self.task_bytes = int(options.get("maxBytes", 256 << 20)), int(options.get("taskBytes", 8 << 20))
        self.quiet = float(options.get("quietSeconds", 2))
        self.first: dict | None = None
        self.at: dict | None = None
        self.seen: dict[str, tuple[int, float]] = {}  # size of a file with an unended line, and since when

    def initialOffset(self) -> dict:
        if self.first is None:  # Spark asks for it again after the latest one, when files may have grown
            self.first = {p: list(where_to_start(p, None, self.tail)) for p in expand(self.patterns)}
        return self.first

    def latestOffset(self) -> dict:
        known = self.initialOffset() if self.at is None else self.at
        paths = expand(self.patterns)
        room = max(BLOCK, self.max_bytes // max(1, len(paths)))
        end = {}
        for path in paths:
            inode, start = where_to_start(path, known.get(path), False)  # a file that appears later is read from its beginning
            size = os.path.getsize(path)
            stop = min(size, start + room)
            to = last_break(path, start, stop)
            if to == start and stop < size:  # a line longer than a batch
                to = next_break(path, stop, size)
                to = start if to == stop else to
            if to < size and stop == size:
                before, since = self.seen.get(path, (-1, 0.0))
                if before != size:
                    self.seen[path] = (size, time.time())
                elif time.time() - since >= self.quiet:
                    to = size
            end[path] = [inode, to]
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.at is None:  # a query that goes on from a checkpoint
            self.at = end
        out = []
        for path, (inode, to) in end.items():
            known = start.get(path)
            at = known[1] if known and known[0] == inode and known[1] <= to else 0
            out += [Range(path, at, to, i, min(i + self.task_bytes, to)) for i in range(at, to, self.task_bytes)]
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from datetime import datetime, timezone

        if partition.path and os.path.exists(partition.path):
            now = datetime.now(timezone.utc)
            for line in lines_between(partition.path, partition.first, partition.last, partition.start, partition.end):
                yield now, ("file", None, partition.path), line, {}


class TailLines(DataSource):
    """`spark.readStream.format("tail_lines")`: options paths (comma-separated patterns), tail, maxBytes, taskBytes, quietSeconds."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options)
