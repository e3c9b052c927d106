"""Following log files that grow, are renamed and are begun anew: a streaming source of lines.

    follow.follow_files(spark, "/var/log/app/*.log*")

The offset of the stream is, for every file that matches, the byte behind its last whole line. A batch
reads what lies between two such offsets, in pieces of bounded size that are cut at line ends, so a line is never
read before it is whole, and never twice: after a restart Spark asks for the very same byte ranges. Where a
batch has many small pieces, as of many files, a task reads several that follow each other.

A file is known by its first line and, where the file system tells it, its inode, not by its name. A
renamed file thus goes on where it was, if the pattern matches the new name as well, and a new file under the old
name begins at 0. A file that is shorter than what was read of it has been cut off and begins
at 0 as well.

Options: `path` (a glob, in a local or mounted folder, or a URI of a file system pyarrow knows),
`startAt` ("beginning", or "end" to take only lines written after the first start), `pieceBytes`. Files without
a whole line are left alone until they have one. Lines end in a line feed; a carriage return before it is
taken away. Bytes that are no UTF-8 become replacement characters. A file's lines carry `file_path` (the name when the batch
was planned), `file_id`, `offset` (the byte where the line begins, by which lines are in order) and `value`.
"""

import fnmatch
import os
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_files"
SCHEMA = "file_path string, file_id string, offset bigint, value string"
# Bytes of a piece that a task reads, of a file that are searched at once for a line end, lines
# of a batch that are handed on at once, and of a first line that take part in a file's id.
PIECE_BYTES = 64 << 20
SEARCH_BYTES = 1 << 16
BATCH_LINES = 8192
HEAD_BYTES = 1024
# Pieces of a batch that get a task each; of more than these a task reads up to so many bytes.
SINGLE_PIECES = 512
TASK_BYTES = 4 << 20


@dataclass
class Piece(InputPartition):
    """Bytes of one file: whole lines from `begin` to before `end`."""

    path: str
    file_id: str
    begin: int
    end: int


@dataclass
class Pieces(InputPartition):
    """Pieces that one task reads one after the other; those of a file are neighbours."""

    pieces: list[Piece]


def _bundled(pieces: list[Piece]) -> list[InputPartition]:
    """The pieces, or tasks of several where there are too many for a task each."""
    if len(pieces) <= SINGLE_PIECES:
        return pieces
    most = min(TASK_BYTES, sum(p.end - p.begin for p in pieces) // SINGLE_PIECES)
    tasks, size = [], most
    for piece in pieces:
        if size + piece.end - piece.begin > most:
            tasks.append(Pieces([]))
            size = 0
        tasks[-1].pieces.append(piece)
        size += piece.end - piece.begin
    return tasks


class _Files:
    """The files of a glob and their bytes."""

    def __init__(self, pattern: str):
        if "://" in pattern or pattern.startswith("file:"):
            self.system, self.pattern = fs.FileSystem.from_uri(pattern.split("*", 1)[0].rsplit("/", 1)[0])
            self.pattern = f"{self.pattern}/{pattern.rsplit('/', 1)[1]}"
        else:
            self.system, self.pattern = fs.LocalFileSystem(), pattern
        self.local = isinstance(self.system, fs.LocalFileSystem)

    def sizes(self) -> dict[str, int]:
        """Size of every file that matches; * and ? do not match a slash, folders take part."""
        parts = self.pattern.split("/")
        fixed = next((i for i, part in enumerate(parts) if any(c in part for c in "*?[")), len(parts) - 1)
        selector = fs.FileSelector("/".join(parts[:fixed]) or "/", recursive=fixed < len(parts) - 1, allow_not_found=True)
        found = {}
        for info in self.system.get_file_info(selector):
            own = info.path.split("/")
            matches = len(own) == len(parts) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(own[fixed:], parts[fixed:], strict=True))
            if info.type == fs.FileType.File and matches:
                found[info.path] = info.size
        return found

    def open(self, path: str):
        return self.system.open_input_file(path)

    def identity(self, path: str, file) -> str | None:
        """The file's id, or None while it has no whole line."""
        head = file.read_at(HEAD_BYTES, 0)
        end = head.find(b"\n")
        if end < 0 and len(head) < HEAD_BYTES:
            return None
        own = os.stat(path).st_ino if self.local else path
        return f"{own}-{zlib.crc32(head[: end if end >= 0 else None]):08x}"

    def identify(self, path: str) -> str | None:
        try:
            with self.open(path) as file:
                return self.identity(path, file)
        except FileNotFoundError:
            return None

    def find(self, path: str, file_id: str) -> str | None:
        """The present name of a file: its last one, or any other of the pattern."""
        if self.identify(path) == file_id:
            return path
        return next((other for other in self.sizes() if other != path and self.identify(other) == file_id), None)


def _last_line_end(file, size: int) -> int:
    """The byte behind the last line feed below `size`; 0 if there is none."""
    while size > 0:
        begin = max(0, size - SEARCH_BYTES)
        at = file.read_at(size - begin, begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        size = begin
    return 0


def _line_end_from(file, begin: int, end: int) -> int:
    """The byte behind the first line feed at or after `begin`; `end` if there is none before it."""
    while begin < end:
        block = file.read_at(min(SEARCH_BYTES, end - begin), begin)
        at = block.find(b"\n")
        if at >= 0:
            return begin + at + 1
        begin += len(block)
    return end


def _lines(file, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines of a range that ends with a line."""
    file.seek(begin)
    rest, at = b"", begin
    while begin < end:
        block = file.read(min(1 << 20, end - begin))
        if not block:
            raise EOFError("the file has become shorter while it was read")
        begin += len(block)
        lines = (rest + block).split(b"\n") if b"\n" in block else [rest + block]
        rest = lines.pop()
        for line in lines:
            yield at, line
            at += len(line) + 1


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"]
        self.piece_bytes = int(options.get("pieceBytes", PIECE_BYTES))
        self.start_at = options.get("startAt", "beginning")
        if self.start_at not in ("beginning", "end"):
            raise ValueError(f"startAt must be 'beginning' or 'end', not {self.start_at!r}")
        if self.piece_bytes < 1:
            raise ValueError("pieceBytes must be positive")

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.start_at == "end" else {}

    def latestOffset(self) -> dict:
        """Of each file's id its name and the end of its last whole line."""
        files, found = _Files(self.pattern), {}
        for path, size in sorted(files.sizes().items()):
            try:
                with files.open(path) as file:
                    file_id, end = files.identity(path, file), _last_line_end(file, size)
            except FileNotFoundError:
                continue
            if file_id is not None and end > 0:
                found[file_id] = {"path": path, "end": end}
        return found

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files, pieces = _Files(self.pattern), []
        for file_id, now in sorted(end.items()):
            begin = start.get(file_id, {"end": 0})["end"]
            if begin > now["end"]:
                begin = 0
            if begin == now["end"]:
                continue
            path = files.find(now["path"], file_id)
            if path is None:
                raise FileNotFoundError(f"{now['path']} ({file_id}) is gone before its lines were read")
            with files.open(path) as file:
                while begin < now["end"]:
                    stop = _line_end_from(file, min(begin + self.piece_bytes, now["end"]) - 1, now["end"])
                    pieces.append(Piece(path, file_id, begin, stop))
                    begin = stop
        return _bundled(pieces)

    def read(self, partition: Piece | Pieces) -> Iterator[pa.RecordBatch]:
        files = _Files(self.pattern)
        for piece in partition.pieces if isinstance(partition, Pieces) else [partition]:
            yield from self._read_piece(files, piece)

    def _read_piece(self, files: _Files, partition: Piece) -> Iterator[pa.RecordBatch]:
        path = files.find(partition.path, partition.file_id)
        if path is None:
            raise FileNotFoundError(f"{partition.path} ({partition.file_id}) is gone before its lines were read")
        with files.open(path) as file:
            offsets, values = [], []
            for at, line in _lines(file, partition.begin, partition.end):
                offsets.append(at)
                values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(values) == BATCH_LINES:
                    yield self._batch(partition, offsets, values)
                    offsets, values = [], []
            if values:
                yield self._batch(partition, offsets, values)

    @staticmethod
    def _batch(piece: Piece, offsets: list[int], values: list[str]) -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array([piece.path] * n), pa.array([piece.file_id] * n), pa.array(offsets, pa.int64()), pa.array(values)]
        return pa.RecordBatch.from_arrays(columns, ["file_path", "file_id", "offset", "value"])


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader(self.options)


# Spark plans a source in a process that knows only installed packages: the source brings its own code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def follow_files(spark: SparkSession, pattern: str, start_at: str = "beginning", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Stream of the lines of all files of a glob, as they are written."""
    options = {"path": pattern, "startAt": start_at, "pieceBytes": str(piece_bytes)}
    GrowingFilesReader(options)  # checks them
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format(FORMAT).options(**options).load()
