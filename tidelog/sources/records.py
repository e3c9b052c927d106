"""A log of record files as a stream whose offsets count records, like those of a queue.

`extend_index` gives every record of a folder of Parquet files a number: a new file gets its place behind all
that are known, once and for all, whatever its name or age. The index is a table of one row per file (first
offset, number of records, first and last time), written by one job at a time.

The stream reads by the index alone. A batch takes at most the admitted number of records, from any
place in any file to any other, so admission does not depend on how large files are; what a batch
has taken is known by two numbers, so that it is the same when it is run again. A stream can begin at an
offset, or at that of an instant: the first record at or after it. It can end at one as well: a batch of few records
costs hardly less than one of many, so a long log is read faster by several streams, each with a share of it.

A task decodes the row groups that hold its records up to its last record, so a file that is read in
small batches is best written with small row groups (`parquet.block.size`).
"""

import gc
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "record_log"
INDEX_SCHEMA = (
    "number bigint, path string, first bigint, n_records bigint, first_seconds bigint, last_seconds bigint"
)
# Most records a task reads at once.
TASK_RECORDS = 1_000_000
# Records of a file that are decoded at once, and bytes that are fetched at once.
BATCH_RECORDS = 8192
BUFFER_BYTES = 1 << 20


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index so far; none where there is no folder yet."""
    try:
        return spark.read.schema(INDEX_SCHEMA).parquet(index)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX_SCHEMA)


def extend_index(spark: SparkSession, folder: str, index: str, seconds: Column | None = None, value: str = "value") -> int:
    """Numbers the records of files that are not in the index yet; returns how many there are in all.

    `seconds` gives a record's time; without it files have none. New files follow in order of their
    last record's time, of modification and of name. Only one row per new file meets in one task.
    """
    known = read_index(spark, index)
    end = known.agg(F.max(F.col("first") + F.col("n_records")).alias("n"), F.max("number").alias("last")).first()
    after, last = end["n"] or 0, -1 if end["last"] is None else end["last"]
    at = F.lit(None).cast("bigint") if seconds is None else seconds
    try:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return after
    files = (
        rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written"), at.alias("at"))
        .groupBy("path")
        .agg(
            F.min("written").alias("written"),
            F.count(F.lit(1)).alias("n_records"),
            F.min("at").alias("first_seconds"),
            F.max("at").alias("last_seconds"),
        )
    )
    order = Window.orderBy(F.col("last_seconds").asc_nulls_first(), "written", "path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = files.join(known.select("path"), "path", "left_anti").select(
        (F.lit(last) + F.row_number().over(order)).cast("bigint").alias("number"),
        "path",
        (F.lit(after) + F.coalesce(F.sum("n_records").over(before), F.lit(0))).cast("bigint").alias("first"),
        "n_records",
        "first_seconds",
        "last_seconds",
    )
    new.coalesce(1).write.mode("append").parquet(index)
    return read_index(spark, index).agg(F.max(F.col("first") + F.col("n_records"))).first()[0] or 0


def offset_at(spark: SparkSession, index: str, instant_seconds: int, seconds: Column) -> int:
    """Offset of the first record at or after an instant; that behind the last one if there is none.

    The index tells the file; only that file is read.
    """
    known = read_index(spark, index)
    file = known.where(F.col("last_seconds") >= instant_seconds).orderBy("number").first()
    if file is None:
        return known.agg(F.max(F.col("first") + F.col("n_records"))).first()[0] or 0
    rows = spark.read.parquet(file["path"]).select(F.col("_metadata.row_index").alias("row"), seconds.alias("at"))
    return file["first"] + rows.where(F.col("at") >= instant_seconds).agg(F.min("row")).first()[0]


@dataclass
class Records(InputPartition):
    """Records of one file, from row `begin` to before row `end`."""

    path: str
    begin: int
    end: int


def _end(files: list[dict]) -> int:
    """Offset behind the last record of files in order."""
    return files[-1]["first"] + files[-1]["n_records"] if files else 0


class RecordLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.index = options["index"]
        self.value = options.get("value", "value")
        self.start = int(options.get("startingOffset", 0))
        self.stop = int(options["endingOffset"]) if "endingOffset" in options else None
        self.most = int(options.get("maxRecordsPerTrigger", 0))
        self.per_task = int(options.get("recordsPerTask", TASK_RECORDS))
        if self.start < 0 or self.most < 0 or self.per_task < 1:
            raise ValueError("offsets and numbers of records must not be negative, and a task reads one at least")
        if self.stop is not None and self.stop < self.start:
            raise ValueError("a stream must not end before it begins")
        # Spark plans the last batch again before it asks for another, so this is known after a restart.
        self.at: int | None = None
        self.known: list[dict] = []

    def _files(self, end: int | None) -> list[dict]:
        """The indexed files; read again only for records behind those known, as an index only grows."""
        if end is None or not self.known or _end(self.known) < end:
            self.known = self._read_files()
        return self.known

    def _read_files(self) -> list[dict]:
        system, path = fs.FileSystem.from_uri(self.index) if ":" in self.index else (fs.LocalFileSystem(), self.index)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return []
        found = pq.read_table(path, filesystem=system, columns=["number", "path", "first", "n_records"]).to_pylist()
        return sorted(found, key=lambda file: file["number"])

    def initialOffset(self) -> dict:
        return {"records": self.start}

    def latestOffset(self) -> dict:
        begin = self.start if self.at is None else self.at
        bounds = [begin + self.most] if self.most else []
        bounds += [] if self.stop is None else [self.stop]
        wanted = min(bounds, default=None)
        end = _end(self._files(wanted))
        self.at = max(begin, end if wanted is None else min(end, wanted))
        return {"records": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.at is None:
            self.at = end["records"]
        parts = []
        for file in self._files(end["records"]):
            begin = max(start["records"] - file["first"], 0)
            stop = min(end["records"] - file["first"], file["n_records"])
            parts += [Records(file["path"], a, min(a + self.per_task, stop)) for a in range(begin, stop, self.per_task)]
        return parts

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        # Keeps what is imported out of the garbage collection that a worker makes after each task.
        if not gc.get_freeze_count():
            gc.freeze()
        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as file:
            # Through a buffer, as else the values of a whole row group are read before the first one.
            opened, row = pq.ParquetFile(file, buffer_size=BUFFER_BYTES), 0
            for group in range(opened.num_row_groups):
                n = opened.metadata.row_group(group).num_rows
                if row >= partition.end:
                    return
                if row + n > partition.begin:
                    at = row
                    for batch in opened.iter_batches(batch_size=BATCH_RECORDS, row_groups=[group], columns=[self.value], use_threads=False):
                        a, b = max(partition.begin - at, 0), min(partition.end - at, batch.num_rows)
                        if a < b:
                            yield batch.slice(a, b - a).rename_columns(["value"]).cast(pa.schema([("value", pa.binary())]))
                        at += batch.num_rows
                        if at >= partition.end:
                            return
                row += n


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value binary"

    def streamReader(self, schema) -> RecordLogReader:
        return RecordLogReader(self.options)


# Spark plans a source in a process that knows only installed packages: the source brings its own code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shares(start: int, end: int, most: int, n: int) -> list[tuple[int, int]]:
    """At most `n` parts of the records from `start` to before `end`, all but the last of whole batches of `most`."""
    per_share = max(1, -(-(end - start) // (most * n))) * most
    return [(begin, min(begin + per_share, end)) for begin in range(start, end, per_share)]


def read_record_log(
    spark: SparkSession,
    index: str,
    max_records_per_trigger: int | None = None,
    starting_offset: int = 0,
    value: str = "value",
    records_per_task: int = TASK_RECORDS,
    ending_offset: int | None = None,
) -> DataFrame:
    """Stream of record bytes by an index; what is indexed later follows, up to `ending_offset`.

    Give it a trigger by time: a run of all that is available now would end after one batch.
    """
    options = {"index": index, "value": value, "startingOffset": starting_offset, "recordsPerTask": records_per_task}
    options["maxRecordsPerTrigger"] = max_records_per_trigger or 0
    if ending_offset is not None:
        options["endingOffset"] = ending_offset
    texts = {name: str(option) for name, option in options.items()}
    RecordLogReader(texts)  # checks them
    spark.dataSource.register(RecordLog)
    return spark.readStream.format(FORMAT).options(**texts).load()
