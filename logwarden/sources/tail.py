"""Streaming source for log files that grow in place (on storage all workers mount).

The driver keeps {path: [[inode, byte], ...]} offsets and looks only at file sizes and at
the bytes after the last complete line. Workers read byte ranges of bounded size.
Only whole lines are emitted: a half-written last line waits for its end.

A path with a new inode was rotated: the old file is looked for by its inode under
any name in the same folder and read on to its end, for as long as it is there. If it is gone
before it was read to its end, the stream fails, and so does a planned read whose file is
gone: nothing is skipped silently. ``on_lost=skip`` gives such bytes up instead. A file that
shrank in place starts again at byte 0 (what a truncation cut off cannot be read).

    register(spark)
    spark.readStream.format("growing_log").option("paths", "a.log,b.log").load()
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source_label string, raw_line string, file_path string, byte_offset bigint"
_PROBE = 1 << 16


class Span(InputPartition):
    """A byte range that starts at a line start and ends after a line end."""

    def __init__(self, label: str, path: str, inode: int, start: int, end: int) -> None:
        super().__init__((label, path, inode, start, end))
        self.label, self.path, self.inode, self.start, self.end = label, path, inode, start, end


def _last_line_end(path: str, low: int, high: int) -> int:
    """Offset just after the last newline in [low, high), or low if there is none."""
    with open(path, "rb") as f:
        while high > low:
            start = max(low, high - _PROBE)
            f.seek(start)
            at = f.read(high - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            high = start
    return low


def _next_line_start(path: str, at: int, limit: int) -> int:
    """Offset just after the first newline at or after ``at``, at most ``limit``."""
    with open(path, "rb") as f:
        f.seek(at)
        while at < limit:
            block = f.read(min(_PROBE, limit - at))
            if not block:
                return limit
            hit = block.find(b"\n")
            if hit >= 0:
                return at + hit + 1
            at += len(block)
    return limit


def _find(path: str, inode: int) -> str | None:
    """Where the file with this inode is: the path itself, or another name in its folder."""
    try:
        if os.stat(path).st_ino == inode:
            return path
    except FileNotFoundError:
        pass
    folder = os.path.dirname(path) or "."
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.inode() == inode and entry.is_file():
                return entry.path
    return None


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._patterns = [p.strip() for p in options["paths"].split(",") if p.strip()]
        self._labels = json.loads(options.get("labels", "{}"))
        self._span = int(options.get("span_bytes", 64 << 20))
        self._per_file = int(options.get("max_bytes_per_file", 1 << 40))
        self._skip_lost = options.get("on_lost", "fail") == "skip"
        self._known: dict[str, list[list[int]]] = {}
        self._unread: dict[tuple[str, int], bool] = {}

    def _files(self) -> list[str]:
        return sorted({f for p in self._patterns for f in glob.glob(p)})

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        latest = {path: [list(x) for x in files] for path, files in self._known.items()}
        for path in sorted({*self._files(), *latest}):
            files = latest.get(path, [])
            try:
                now = os.stat(path).st_ino
            except FileNotFoundError:
                now = None  # rotated away and not yet written anew
            # rotated files go on being read under their new names, the newest comes last
            kept = [k for k in (self._advance(path, *f, rotated=f[0] != now) for f in files) if k]
            # a pattern may match a rotated file's new name too: it is read once, under the old one
            elsewhere = {f[0] for other, some in latest.items() if other != path for f in some}
            if now is not None and now not in elsewhere and all(f[0] != now for f in files):
                fresh = self._advance(path, now, 0, rotated=False)
                kept += [fresh] if fresh else []
            if kept or path in latest:
                latest[path] = kept
        self._known = latest
        return latest

    def _advance(self, path: str, inode: int, start: int, rotated: bool) -> list[int] | None:
        """The file's offset after what can be read of it now; None if it is gone and done with."""
        try:
            found = _find(path, inode)
            if found is None:
                if rotated and not self._skip_lost and self._unread.get((path, inode), True):
                    raise RuntimeError(
                        f"{path}: the file with inode {inode} is gone before its end was read "
                        "(on_lost=skip gives it up)")
                return None
            size = os.stat(found).st_size
            if size < start:
                start = 0
            high = min(size, start + self._per_file)
            if rotated and high == size:
                end = size  # nobody finishes its last line any more
            else:
                end = _last_line_end(found, start, high)
                if end == start and high < size:
                    # one line longer than the limit: take it whole
                    end = _last_line_end(found, start, _next_line_start(found, high, size))
        except FileNotFoundError:
            return [inode, start]  # renamed between two looks; seen next time
        # a rotated file that was read to its end may be deleted
        self._unread[path, inode] = not rotated or end < size
        return [inode, end]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # after a restart this is the first place that learns the committed offset
        for path, offset in end.items():
            self._known.setdefault(path, offset)
        spans: list[InputPartition] = []
        for path, files in end.items():
            before = {inode: at for inode, at in start.get(path, [])}
            label = self._labels.get(path, os.path.basename(path))
            for inode, stop in files:
                at = before.get(inode, 0)
                if stop < at:
                    at = 0
                found = _find(path, inode)
                while at < stop:
                    cut = stop
                    if at + self._span < stop and found:
                        cut = _next_line_start(found, at + self._span, stop)
                    spans.append(Span(label, path, inode, at, cut))
                    at = cut
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        found = _find(partition.path, partition.inode)
        if found is None:
            if self._skip_lost:
                return
            raise FileNotFoundError(f"{partition.path}: its file with inode {partition.inode} is gone")
        with open(found, "rb") as f:
            # a rotation in between must not make the successor's bytes the old file's
            if os.fstat(f.fileno()).st_ino != partition.inode:
                raise FileNotFoundError(f"{found} was renamed while it was opened; read again")
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text:
                    yield partition.label, text, partition.path, at
                at += len(line)


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingLogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLog)
