"""Queries on files that grow while a stream follows them."""

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import work_folder
from tidelog.sources import follow
from tidelog.streaming import entries
from workload import derive
from workload.registry import query

# Documents of a file.
PER_FILE = 100
_LINES = f"""WITH {derive.LINES}, placed AS (SELECT doc_id // {PER_FILE} AS file, line,
  row_number() OVER (PARTITION BY doc_id // {PER_FILE} ORDER BY doc_id, line_no) AS line_no FROM lines)"""


def _part_written(folder: str, first: float, last: float):
    """Writes the bytes of a file from one share of it to another, behind what is there; may be run again."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        (number,) = (k.as_py() for k in key)
        texts = rows.sort_by("doc_id")["text"].to_pylist()
        content = "".join(text + "\n" for text in texts).encode()
        begin, end = int(len(content) * first), int(len(content) * last)
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{number}.log", "r+b" if begin else "wb") as file:
            file.truncate(begin)
            file.seek(begin)
            file.write(content[begin:end])
        return pa.table({"bytes": pa.array([end - begin], pa.int64())})

    return write


def _grow(spark: SparkSession, sf_dir: str, folder: str, first: float, last: float) -> None:
    docs = derive.table(spark, sf_dir, "documents").where("text is not null")
    by_file = docs.select("doc_id", "text", F.floor(F.col("doc_id") / PER_FILE).alias("file")).groupBy("file")
    path = folder.removeprefix("file:").replace("///", "/")
    by_file.applyInArrow(_part_written(path, first, last), "bytes bigint").agg(F.sum("bytes")).collect()


def _in_two_runs(spark: SparkSession, sf_dir: str, run: Callable[[str, bool], None]) -> None:
    """Two runs on one checkpoint; between them the files grow from the middle of a line on."""
    folder = work_folder(spark, "growing")
    for first, last in ((0.0, 0.43), (0.43, 1.0)):
        _grow(spark, sf_dir, folder, first, last)
        run(f"{folder}/*.log", last == 1.0)


def _ranked(rows: DataFrame) -> DataFrame:
    file = F.regexp_extract("file_path", r"/(\d+)\.log$", 1).cast("bigint")
    by_file = Window.partitionBy("file").orderBy("offset")
    return rows.withColumn("file", file).withColumn("number", F.row_number().over(by_file).cast("bigint"))


@query("a9_followed_files", _LINES + " SELECT file, line_no, line FROM placed")
def _(spark, sf):
    """Lines that are written to files after these have been read come once each, also after a restart."""
    root = work_folder(spark, "followed")

    def run(pattern: str, last: bool) -> None:
        lines = follow.follow_files(spark, pattern, piece_bytes=1 << 20)
        writer = lines.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
        stream = writer.start(f"{root}/table")
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    _in_two_runs(spark, sf, run)
    rows = _ranked(spark.read.parquet(f"{root}/table"))
    return rows.select("file", F.col("number").alias("line_no"), F.col("value").alias("line"))


@query(
    "g5_multiline_across_batches",
    _LINES + """, marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-D]') THEN 1 ELSE 0 END)
    OVER (PARTITION BY file ORDER BY line_no) AS start FROM placed),
grouped AS (SELECT file, start, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS message FROM marked GROUP BY ALL)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY start) AS entry, n_lines, message FROM grouped""",
)
def _(spark, sf):
    """Entries that are cut over pieces, batches and a restart come out once and whole."""
    root = work_folder(spark, "entries")

    def run(pattern: str, last: bool) -> None:
        lines = follow.follow_files(spark, pattern, piece_bytes=20_000)
        quiet = 3 if last else 3600
        stream = entries.start_entries(lines, "^[A-D]", f"{root}/table", f"{root}/checkpoint", quiet, trigger_seconds=0.5)
        try:
            entries.drain(stream, close=last)
        finally:
            stream.stop()

    _in_two_runs(spark, sf, run)
    rows = _ranked(spark.read.parquet(f"{root}/table"))
    return rows.select("file", F.col("number").alias("entry"), "n_lines", "message")
