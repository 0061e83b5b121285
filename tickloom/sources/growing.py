"""Log files that grow: what is new since the last look, as segments that end at a fence.

A file source sees a file once; a service's log is one file that is appended to. ``advance`` looks
at every file's length, and copies what was added, up to the last fence, into immutable segments in
a folder that a text stream reads. A segment's name holds the file and its byte range, so the folder
itself is the state: the next look starts where the last segment ends, and a look that dies half-way
is simply repeated. Segments are copied through a buffer, never held whole, and cut to a bounded size,
so a long backlog is read by many tasks.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import SparkSession

from tickloom.sources.logs import FENCE

SEGMENT = 64 << 20          # bytes after which a segment ends at the next fence
BLOCK = 1 << 20             # bytes read at once
NAME = re.compile(r"([0-9a-f]{16})-(\d{4})-(\d{20})-(\d{20})\.log$")


class GrowingLog:
    """The files under ``path``, and their segments in ``segments``."""

    def __init__(self, spark: SparkSession, path: str, segments: str, fence: str = FENCE) -> None:
        self.spark, self.path, self.segments = spark, path.rstrip("/"), segments.rstrip("/")
        self.fence = (fence + "\n").encode()
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self._conf)

    def _list(self, path: str) -> list[tuple[str, int]]:
        folder, fs = self._at(path)
        if not fs.exists(folder):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder) if s.isFile())

    def read_so_far(self) -> dict[str, tuple[int, int]]:
        """Per file (a hash of its name): its generation, and the byte up to which it was read."""
        done: dict[str, tuple[int, int]] = {}
        for name, _ in self._list(self.segments):
            if match := NAME.match(name):
                key, generation, end = match[1], int(match[2]), int(match[4])
                done[key] = max(done.get(key, (0, 0)), (generation, end))
        return done

    def advance(self) -> int:
        """Copy what is new into segments; returns their number. A file shorter than what was read
        of it has been replaced: it is read from its start, as a new generation."""
        done, made = self.read_so_far(), 0
        for name, length in self._list(self.path):
            if name.startswith(("_", ".")):
                continue
            key = hashlib.sha256(name.encode()).hexdigest()[:16]
            generation, start = done.get(key, (0, 0))
            if length < start:
                generation, start = generation + 1, 0
            while start < length:
                end = self._copy(name, key, generation, start, length)
                if end == start:
                    break                   # no fence yet: the record is still being written
                start, made = end, made + 1
        return made

    def _copy(self, name: str, key: str, generation: int, start: int, length: int) -> int:
        """One segment from ``start`` to a fence; returns its end, ``start`` if there is no fence."""
        end = self._fence_end(name, start, length)
        if end == start:
            return start
        source, fs = self._at(f"{self.path}/{name}")
        draft, out_fs = self._at(f"{self.segments}/.draft-{uuid.uuid4().hex}")
        stream, out = fs.open(source), out_fs.create(draft, True)
        try:
            stream.seek(start)
            self._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, end - start)
        finally:
            out.close()
            stream.close()
        final, _ = self._at(f"{self.segments}/{key}-{generation:04d}-{start:020d}-{end:020d}.log")
        out_fs.rename(draft, final)
        return end

    def _fence_end(self, name: str, start: int, length: int) -> int:
        """The end of the last fence in the next ``SEGMENT`` bytes; beyond that, of the first."""
        source, fs = self._at(f"{self.path}/{name}")
        stream = fs.open(source)
        try:
            stop = min(start + SEGMENT, length)
            at = stop                       # backwards from the segment's greatest end
            while at > start:
                low = max(start, at - BLOCK)
                found = self._read(stream, low, min(at + len(self.fence) - 1, length)).rfind(self.fence)
                if found >= 0:
                    return low + found + len(self.fence)
                at = low
            while stop < length:            # a record longer than a segment
                high = min(stop + BLOCK, length)
                low = max(start, stop - len(self.fence) + 1)
                found = self._read(stream, low, high).find(self.fence)
                if found >= 0:
                    return low + found + len(self.fence)
                stop = high
        finally:
            stream.close()
        return start

    @staticmethod
    def _read(stream, low: int, high: int) -> bytes:
        stream.seek(low)
        return bytes(stream.readNBytes(high - low))
