"""Token ids as files of equal-length sequences in the Arrow stream format.

Documents in ascending order of their ids are written one after the other, each with the end id
behind it, and the row of ids is cut into sequences of equal length. A part of the documents is
one folder entry of two files, each a single Arrow stream:

    <part>.tokens.arrow   ids: fixed_size_list<uint16 or uint32>[length]
                          mask: fixed_size_list<bool>[length], one bit for each: false where the
                          last sequence is filled up behind the last document
    <part>.docs.arrow     doc_id, start (within the part), n_tokens

Every batch but the last holds the same number of sequences, without NULLs and with plain buffers.
A reader maps the file into memory and takes the sequences, masks or documents it wants as
views of the map: nothing is copied, whatever the place. On a file system that cannot be mapped the
same reader works on the file's bytes.

Parts come from one range shuffle by id. The task that has a range encodes it in batches of
bounded size and streams it to its files. What it returns, a row per document, is the index
table; Spark commits it with the task, so that only files of attempts that succeeded are ever named
in it. An attempt that is lost leaves files that nobody reads. Files lie below a folder that
all executors share.

Cases: a NULL text is an empty one and has the end id alone; NULL ids come first; equal ids are
ordered by their texts' hashes, then as they come; texts of any length are encoded in slices,
and only the ids of one document at a time must fit in memory; repeated rows are written as often as they come; an
empty table gives no files and an empty result; other columns are not read.
"""

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.batches import in_pieces
from tidelog.llm.part_encoder import shared_encoder
from tidelog.llm.words import text_or_empty

# Ids of a sequence, sequences of a batch, and bytes of text that are encoded at once.
LENGTH = 1024
BATCH_SEQUENCES = 256
PIECE_BYTES = 4 << 20
INDEX = "part int, file string, doc_id {id}, offset bigint, n_tokens bigint"
READ = "part int, doc_id {id}, offset bigint, n_tokens bigint, ids_crc32 bigint"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class SequenceWriter:
    """Writes documents' ids to the two files of a part."""

    def __init__(self, stem: str, id_type: pa.DataType, dtype: np.dtype, length: int):
        system, path = _located(stem)
        system.create_dir(os.path.dirname(path), recursive=True)
        self.length, self.dtype = length, dtype
        ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), length)
        mask = pa.list_(pa.field("item", pa.bool_(), nullable=False), length)
        self.schema = pa.schema([pa.field("ids", ids, nullable=False), pa.field("mask", mask, nullable=False)])
        self.docs_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [system.open_output_stream(f"{path}.{kind}.arrow") for kind in ("tokens", "docs")]
        self.tokens = pa.ipc.new_stream(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_stream(self.sinks[1], self.docs_schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.written = 0

    def add(self, doc_ids: pa.Array, documents: list[np.ndarray]) -> tuple[list[int], list[int]]:
        """Adds documents, their end ids included; returns where they start and their lengths."""
        counts = [len(d) for d in documents]
        starts = (self.written + np.cumsum([0, *counts])[:-1]).tolist()
        self.docs.write_batch(
            pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=self.docs_schema)
        )
        self.written += sum(counts)
        self.waiting += documents
        self.n_waiting += sum(counts)
        self._flush(self.length * BATCH_SEQUENCES)
        return starts, counts

    def _flush(self, unit: int) -> None:
        """Writes whole batches of what waits, each of `unit` ids."""
        if self.n_waiting < unit:
            return
        ids = np.concatenate(self.waiting)
        whole = len(ids) // unit * unit
        for begin in range(0, whole, unit):
            self._write(ids[begin : begin + unit], unit)
        self.waiting = [ids[whole:]]
        self.n_waiting -= whole

    def _write(self, ids: np.ndarray, known: int) -> None:
        """Writes a batch of which the first `known` ids are documents'."""
        values = pa.array(ids), pa.array(np.arange(len(ids)) < known)
        columns = [pa.FixedSizeListArray.from_arrays(v, type=f.type) for v, f in zip(values, self.schema, strict=True)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            ids = np.concatenate(self.waiting)
            self._write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        for stream in (self.tokens, self.docs, *self.sinks):
            stream.close()


class SequenceFile:
    """Random access to a part's sequences, masks and documents, as views of the mapped file."""

    def __init__(self, stem: str):
        self.batches, self.schema = self._stream(stem, "tokens")
        docs, schema = self._stream(stem, "docs")
        self.docs = pa.Table.from_batches(docs, schema)
        self.length = self.schema.field("ids").type.list_size
        self.flat = [b.column("ids").values.to_numpy(zero_copy_only=True) for b in self.batches]
        self.masks = [b.column("mask").values for b in self.batches]
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    @staticmethod
    def _stream(stem: str, kind: str) -> tuple[list[pa.RecordBatch], pa.Schema]:
        system, path = _located(f"{stem}.{kind}.arrow")
        local = isinstance(system, fs.LocalFileSystem)
        source = pa.memory_map(path) if local else pa.py_buffer(system.open_input_file(path).readall())
        with pa.ipc.open_stream(source) as reader:
            return list(reader), reader.schema

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def ids(self, number: int) -> np.ndarray:
        """Ids of a sequence, without a copy."""
        batch, row = divmod(number, self.per_batch)
        return self.flat[batch][row * self.length : (row + 1) * self.length]

    def mask(self, number: int) -> pa.BooleanArray:
        """Mask of a sequence, without a copy."""
        batch, row = divmod(number, self.per_batch)
        return self.masks[batch].slice(row * self.length, self.length)

    def document(self, start: int, n_tokens: int) -> list[np.ndarray]:
        """Views that make up a document's ids: one for each batch it lies in."""
        unit = self.per_batch * self.length
        views = []
        while n_tokens > 0:
            batch, at = divmod(start, unit)
            views.append(self.flat[batch][at : at + n_tokens])
            start += len(views[-1])
            n_tokens -= len(views[-1])
        return views


def _writing(tokenizer_path: str, folder: str, end_id: int, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = None
        part = TaskContext.get().partitionId()
        file = f"part-{part:06d}-{uuid.uuid4().hex}"
        try:
            for batch in in_pieces(batches, "text", PIECE_BYTES):
                if writer is None:
                    encoder = shared_encoder(tokenizer_path)
                    writer = SequenceWriter(f"{folder}/{file}", batch.column("doc_id").type, encoder.dtype, length)
                end = np.array([end_id], encoder.dtype).tobytes()
                encoded = encoder.encode(batch.column("text").to_pylist())
                documents = [np.frombuffer(ids + end, encoder.dtype) for ids in encoded]
                starts, counts = writer.add(batch.column("doc_id"), documents)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([file] * n, pa.string()),
                        batch.column("doc_id"),
                        pa.array(starts, pa.int64()),
                        pa.array(counts, pa.int64()),
                    ],
                    ["part", "file", "doc_id", "offset", "n_tokens"],
                )
        finally:
            # Before the task ends, so that its rows are committed only with whole files.
            if writer is not None:
                writer.close()

    return run


def _reading(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), strict=True):
                opened = SequenceFile(f"{folder}/{file}")
                for docs in opened.docs.to_batches(max_chunksize=10_000):
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for view in opened.document(start, n):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(sums), pa.int32()), *docs.columns, pa.array(sums, pa.int64())],
                        ["part", "doc_id", "offset", "n_tokens", "ids_crc32"],
                    )

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 2,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes all documents below `folder`; returns the index that is written beside the files.

    The index has the columns part, file, doc_id, offset (within the part) and n_tokens.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = INDEX.format(id=rows.schema["doc_id"].dataType.simpleString())
    ranged.mapInArrow(_writing(tokenizer_path, f"{folder}/files", end_id, length), schema).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files an index names: doc_id, start, n_tokens and ids_crc32.

    `start` counts the ids of all documents before it. Files are read once each, one in a task;
    only one row per file, its number of ids, meets in one task.
    """
    spark = index.sparkSession
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    schema = READ.format(id=index.schema["doc_id"].dataType.simpleString())
    n_files = max(1, files.count())
    spread = files.select("part", "file").repartitionByRange(n_files, "part")
    read = spread.mapInArrow(_reading(f"{folder}/files"), schema)
    return read.join(starts, "part").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
