"""Entries of several lines in a stream: kept open over batches, closed by the next start or by silence.

Lines of a followed file are first joined to fragments within the piece that a task reads. An entry that
both begins and is followed by another within a piece is whole and needs nothing else. Only what
touches the edges of a piece, its first fragment and its last one, meets in the state of the file: there an
open entry waits for more of its lines, whichever batch brings them. It is closed when another one begins, or by a
timer when its file has had no lines for some time. So a file that grows faster than all others is still read
and joined by many tasks; the state sees two rows a piece.

State and timers are part of the checkpoint: a query that is stopped and started again goes on with the
same open entries. An entry is named by its file and the byte at which it begins.
"""

import sys
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

FRAGMENT = "file_id string, file_path string, offset bigint, n_lines bigint, message string, starts boolean, closed boolean, edge boolean"
ENTRY = "file_id string, file_path string, offset bigint, n_lines bigint, message string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Groups that whole entries of all files are dealt to; the state of each file is a group of its own.
SPREAD = 1024


class _Piece:
    """Joins the lines of one piece; `file` is its id and name."""

    def __init__(self, file: tuple[str, str]):
        self.file, self.first = file, True
        self.offset, self.lines, self.starts = None, [], False

    def _fragment(self, closed: bool) -> tuple:
        edge = self.first or not closed
        self.first = False
        return (*self.file, self.offset, len(self.lines), "\n".join(self.lines), self.starts, closed, edge)

    def add(self, offsets: np.ndarray, starts: np.ndarray, texts: list[str]) -> Iterator[tuple]:
        begin = 0
        for at in [*np.flatnonzero(starts).tolist(), len(texts)]:
            if self.offset is None and at > begin:
                self.offset = int(offsets[begin])
            self.lines += texts[begin:at]
            if at < len(texts):
                if self.offset is not None:
                    yield self._fragment(closed=True)
                self.offset, self.lines, self.starts = int(offsets[at]), [], True
            begin = at

    def end(self) -> Iterator[tuple]:
        if self.offset is not None:
            yield self._fragment(closed=False)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [column.split()[0] for column in FRAGMENT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _join_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the lines of a task, which come in the order of each file's piece."""
    piece = None
    for batch in batches:
        ids, names = batch.column("file_id").to_pylist(), batch.column("file_path").to_pylist()
        offsets = batch.column("offset").to_numpy()
        starts = batch.column("starts").to_numpy(zero_copy_only=False)
        texts = batch.column("value").to_pylist()
        found, begin = [], 0
        while begin < len(ids):
            stop = begin + 1
            while stop < len(ids) and ids[stop] == ids[begin]:
                stop += 1
            if piece is None or piece.file[0] != ids[begin]:
                found += piece.end() if piece else []
                piece = _Piece((ids[begin], names[begin]))
            found += piece.add(offsets[begin:stop], starts[begin:stop], texts[begin:stop])
            begin = stop
        yield _batch(found)
    if piece:
        yield _batch(list(piece.end()))


class OpenEntries(StatefulProcessor):
    """The open entry of each file: where it begins, how many lines it has, and its texts so far."""

    def __init__(self, quiet_seconds: float):
        self.quiet = int(quiet_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "file_path string, offset bigint, n_lines bigint")
        self.texts = handle.getListState("texts", "value string")

    def _close(self, file_id: str) -> tuple:
        path, offset, n_lines = self.open.get()
        message = "\n".join(text for (text,) in self.texts.get())
        self.open.clear()
        self.texts.clear()
        return file_id, path, offset, n_lines, message

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [column.split()[0] for column in ENTRY.split(", ")]
        file_id, group = key
        if group >= 0:
            for batch in rows:
                yield batch.drop(columns="file_id").rename(columns={"own_id": "file_id"})[names]
            return
        done = []
        fragments = pd.concat(list(rows)).sort_values("offset", kind="stable")
        for f in fragments.itertuples(index=False):
            if f.starts and self.open.exists():
                done.append(self._close(file_id))
            if self.open.exists():
                path, offset, n_lines = self.open.get()
            else:
                path, offset, n_lines = f.file_path, int(f.offset), 0
            self.open.update((path, offset, n_lines + int(f.n_lines)))
            self.texts.appendValue((f.message,))
            if f.closed:
                done.append(self._close(file_id))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.open.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield pd.DataFrame(done, columns=names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = [self._close(key[0])] if self.open.exists() else []
        yield pd.DataFrame(done, columns=[column.split()[0] for column in ENTRY.split(", ")])

    def close(self) -> None:
        pass


# Spark prepares a processor in a process that knows only installed packages: it brings its own code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def followed_entries(lines: DataFrame, start_pattern: str, quiet_seconds: float = 5) -> DataFrame:
    """Stream of entries of followed files: file_id, file_path, offset, n_lines and message.

    A line that matches `start_pattern` (a Java regular expression) starts an entry; lines before a
    file's first start form one of their own. `quiet_seconds` without new lines close a file's
    open entry; lines that still come after that form an entry of their own.
    """
    marked = lines.select("file_id", "file_path", "offset", "value", F.col("value").rlike(start_pattern).alias("starts"))
    fragments = marked.mapInArrow(_join_pieces, FRAGMENT)
    # Groups cost more than rows: their number must not grow with the files.
    group = F.when(F.col("edge"), -1).otherwise(F.pmod(F.hash("file_id", "offset"), F.lit(SPREAD)))
    owner = F.when(F.col("edge"), F.col("file_id")).otherwise(F.lit(""))
    return (
        fragments.withColumns({"group": group, "own_id": F.col("file_id"), "file_id": owner})
        .groupBy("file_id", "group")
        .transformWithStateInPandas(OpenEntries(quiet_seconds), ENTRY, "append", "processingTime")
    )


def use_state_store(spark: SparkSession) -> None:
    """State with timers needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def start_entries(
    lines: DataFrame,
    start_pattern: str,
    root: str,
    checkpoint: str,
    quiet_seconds: float = 5,
    trigger_seconds: float = 60,
    name: str = "entries-of-growing-files",
) -> StreamingQuery:
    """Starts the stream of entries to the Parquet table `root`, where each lands exactly once.

    The trigger goes on while no lines come, as timers are looked at once in each batch.
    """
    use_state_store(lines.sparkSession)
    entries = followed_entries(lines, start_pattern, quiet_seconds)
    writer = entries.writeStream.queryName(name).format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=f"{trigger_seconds} seconds").start(root)


def drain(query: StreamingQuery, close: bool = False, timeout_seconds: float = 600, poll_seconds: float = 0.2) -> None:
    """Waits until a batch has found no new lines and, with `close`, no file has an open entry.

    For runs that end; a stream with timers never runs out of batches by itself. `timeout_seconds` count from
    the last batch with lines, however many there are.
    """
    deadline = time.monotonic() + timeout_seconds
    first = seen = query.lastProgress["batchId"] if query.lastProgress else -1
    while query.isActive:
        progress = query.lastProgress
        if progress and progress["batchId"] > seen:
            seen = progress["batchId"]
            if progress["numInputRows"]:
                deadline = time.monotonic() + timeout_seconds
        if progress and progress["batchId"] > first + 1 and progress["numInputRows"] == 0:
            kept = sum(state["numRowsTotal"] for state in progress["stateOperators"])
            if not close or kept == 0:
                return
        if time.monotonic() > deadline:
            raise TimeoutError(f"the stream {query.name} still had lines or open entries {timeout_seconds} s after its last lines")
        query.awaitTermination(poll_seconds)
    if query.exception():
        raise query.exception()
