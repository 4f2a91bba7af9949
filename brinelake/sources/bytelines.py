"""Lines as bytes, exactly as they lie in files (S1, S2): a data source for what is not text.

The text reader takes lines for UTF-8; a binary record between sentences survives it only by luck.
This source splits files at byte offsets and gives every line as bytes with its file, its offset
and the piece it was read in. A line belongs to the piece in which it begins; pieces are read in
bounded buffers and handed over as Arrow batches. A piece is a task of its own while there are few;
of many small ones a task reads a run, one piece after the other.

    spark.dataSource.register(ByteLines)
    spark.read.format("byte_lines").option("piece", 1 << 25).load("landing/*.nmea")
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE, BUFFER = 1 << 25, 1 << 22
#: Bytes read beyond a piece for the rest of its last line, doubled while the line goes on.
TAIL = 1 << 12
#: Of more pieces than twice as many a task reads a run, of ``PIECE`` bytes at most.
TASKS = 1 << 10
SCHEMA = "line binary, file_path string, block_start bigint, offset bigint"


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    size: int  # of the pieces in it


def _located(path: str):
    """File system and name; a path without a scheme is local."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files below a folder, or of those that match a name pattern."""
    from pyarrow import fs

    folder, _, pattern = path.rpartition("/") if any(c in path.rsplit("/", 1)[-1] for c in "*?[") else (path, "", "*")
    files, name = _located(folder)
    info = files.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File
                  and fnmatch.fnmatch(i.base_name, pattern) and not i.base_name.startswith((".", "_")))


def lines_of(source, start: int, end: int, buffer: int = BUFFER) -> Iterator[list[tuple[int, bytes]]]:
    """(offset, bytes) of the lines that begin in a piece, a buffer's worth at a time."""
    at = read_to = max(0, start - 1)
    source.seek(at)
    held, tail = b"", TAIL

    def more() -> bytes:
        """What is left of the piece, or a little more of a line that goes on beyond it."""
        nonlocal read_to, tail
        left = end - read_to
        data = source.read(min(buffer, max(left, tail)))
        if left <= 0:
            tail *= 2
        read_to += len(data)
        return data

    if start > 0:  # the line that runs into the piece belongs to the one before
        while True:
            data = more()
            cut = data.find(b"\n")
            if cut >= 0:
                at, held = at + cut + 1, data[cut + 1:]
                break
            at += len(data)
            if not data:
                return
    parts = [held]
    while at < end:
        data = more()
        parts.append(data)
        if data and b"\n" not in data:  # a line longer than the buffer
            continue
        rows = b"".join(parts).split(b"\n")
        last = rows.pop()
        if not data and last:
            rows, last = [*rows, last], b""
        out = []
        for row in rows:
            if at < end:
                out.append((at, row))
            at += len(row) + 1
        if out:
            yield out
        parts = [last]
        if not data:
            return


class ByteLinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))

    def partitions(self) -> list[Piece]:
        scheme = self.path.split("://", 1)[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        files = _files(self.path)
        pieces = sum(-(-size // self.piece) for _, size in files)
        run = max(1, min(pieces // TASKS, PIECE // self.piece)) * self.piece
        return [Piece(scheme + p, k, min(size, k + run), self.piece) for p, size in files
                for k in range(0, size, run)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, name = _located(partition.path)
        with files.open_input_file(name) as source:
            found, held = [], 0
            for start in range(partition.start, partition.end, partition.size):
                for rows in lines_of(source, start, min(start + partition.size, partition.end)):
                    found.append((start, rows))
                    held += rows[-1][0] + len(rows[-1][1]) - rows[0][0]
                    if held >= BUFFER:
                        yield _batch(partition.path, found)
                        found, held = [], 0
            if found:
                yield _batch(partition.path, found)


def _batch(path: str, found: list[tuple[int, list[tuple[int, bytes]]]]) -> pa.RecordBatch:
    """Rows of one file by the starts of their pieces."""
    starts = [start for start, rows in found for _ in rows]
    rows = [r for _, rows in found for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([r for _, r in rows], pa.binary()), pa.array([path] * len(rows), pa.string()),
         pa.array(starts, pa.int64()), pa.array([o for o, _ in rows], pa.int64())],
        names=["line", "file_path", "block_start", "offset"])


class ByteLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ByteLinesReader:
        return ByteLinesReader(self.options)


def read_byte_lines(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """The lines of a file, of a folder, or of the files of a name pattern, as bytes."""
    spark.dataSource.register(ByteLines)
    return spark.read.format("byte_lines").option("piece", str(piece)).load(path)
