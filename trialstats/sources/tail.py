"""A streaming source that follows growing log files by byte offsets.

An offset names, per file, the byte after its last complete line. Grown files are read on from there, and a last line
without its newline waits until the newline is there. Files that were consumed whole and then rested for ``idle`` seconds
leave the offset, which so holds the files in use only; like an aged file of Spark's own source, a file must not
be moved in with a modification time older than that, nor written again.

Options: ``path`` (a folder or a file; any address that Arrow's file systems open), ``idle`` (a day), ``split`` (bytes of a
task, 64 MB).
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start bigint, value string, utf8 boolean"
IDLE = 86_400
SPLIT = 1 << 26
#: bytes read at once, and lines of a batch
BLOCK = 1 << 16
LINES = 4096


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    # a plain path with characters of an address (spaces, percent signs) is not one
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def last_line_end(fs: pafs.FileSystem, name: str, size: int, known: int) -> int:
    """Byte after the last newline before ``size``, looking back no further than ``known``."""
    with fs.open_input_file(name) as f:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return known


def lines_from(f, start: int, begin: int, end: int, limit: int) -> Iterator[tuple[int, bytes]]:
    """Lines of bytes start..limit of an open file that begin in begin..end, with their places."""
    at, held = begin, b""
    if begin > start:  # the line that holds the byte before is another task's, unless it ends there
        at, skip = begin - 1, True
    else:
        skip = False
    place = at
    while place < end or skip:
        block = f.read_at(min(BLOCK, limit - at), at) if at < limit else b""
        if not block:
            return
        at += len(block)
        held += block
        *whole, held = held.split(b"\n")
        for line in whole:
            if skip:
                skip = False
            elif place < end:
                yield place, line
            else:
                return
            place += len(line) + 1


class Span(InputPartition):
    def __init__(self, name: str, start: int, begin: int, end: int, limit: int):
        self.name, self.start, self.begin, self.end, self.limit = name, start, begin, end, limit


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.idle, self.split = float(options.get("idle", IDLE)), int(options.get("split", SPLIT))
        self.consumed: dict = {"before": 0, "files": {}}
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"before": 0, "files": {}}

    def latestOffset(self) -> dict:
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        before = max(self.consumed["before"], int((time.time() - self.idle) * 1e9))
        files = {}
        for i in found:
            if i.type != pafs.FileType.File or i.base_name.startswith((".", "_")):
                continue
            size, known = self.seen.get(i.path, (0, 0))
            if i.size > size:
                known = last_line_end(fs, i.path, i.size, known)
            self.seen[i.path] = (i.size, known)
            done = self.consumed["files"].get(i.path)
            old = i.mtime_ns <= self.consumed["before"] and done is None
            if old or (i.mtime_ns <= before and done is not None and done["end"] == known):
                continue  # consumed whole and at rest
            files[i.path] = {"end": known, "changed": i.mtime_ns}
        return {"before": before, "files": files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name, now in sorted(end["files"].items()):
            was = start["files"].get(name)
            if was is None and now["changed"] <= start["before"]:
                continue  # left the offset earlier; listed again by a restarted reader
            begin = was["end"] if was else 0
            out += [Span(name, begin, at, min(at + self.split, now["end"]), now["end"]) for at in range(begin, now["end"], self.split)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)

        def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            texts = [line.decode("utf-8", "replace") for _, line in rows]
            same = [t.encode() == line for t, (_, line) in zip(texts, rows, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.name] * len(rows)), pa.array([p for p, _ in rows], pa.int64()), pa.array(texts, pa.string()),
                 pa.array(same, pa.bool_())], ["file", "start", "value", "utf8"])

        rows: list[tuple[int, bytes]] = []
        with fs.open_input_file(partition.name) as f:
            for row in lines_from(f, partition.start, partition.begin, partition.end, partition.limit):
                rows.append(row)
                if len(rows) == LINES:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    def commit(self, end: dict) -> None:
        self.consumed = end


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream of the complete lines under ``path``: file, place in it, text, and whether it is valid UTF-8."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=path, **options).load()


def append_lines(lines: DataFrame, path: str) -> int:
    """Append the texts of (file, place, text) to the named log files in order of place; returns the bytes written.

    Texts hold their own newlines. Each file is one task's, as it is one writer's. A task that is run again appends its
    lines again, as a writer that comes back does; ingest keeps each id once.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        written, name, f = 0, None, None
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != name:
                    if f:
                        f.close()
                    name, f = own, fs.open_append_stream(f"{folder}/{own}.jsonl")
                data = text.encode()
                f.write(data)
                written += len(data)
        if f:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["bytes"])

    dealt = lines.repartition("file").sortWithinPartitions("file", "place").select("file", "text")
    return dealt.mapInArrow(write, "bytes bigint").agg({"bytes": "sum"}).first()[0] or 0
