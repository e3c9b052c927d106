"""Grouping of text lines into entries that may span several of them.

A file may hold most of the lines, so nothing is done per file but to sum counts of chunks, which
are aggregated before they are shuffled. Which entry a chunk begins in, and how far into it,
follows from these sums, whatever the length of lines, entries and files.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timefmt import int_div

_PLACE = ["_file", "_block", "_chunk"]


def _joined(texts: Column) -> Column:
    """Texts of (place, text) structs in order of place, one per line."""
    return F.array_join(F.transform(F.sort_array(texts), lambda t: t["text"]), "\n")


def _chunked(
    lines: DataFrame, start_pattern: str, file: str, block: str, row: str, text: str, chunk_lines: int
) -> DataFrame:
    return lines.select(
        F.col(file).alias("_file"),
        F.col(block).cast("bigint").alias("_block"),
        int_div(F.col(row).cast("bigint"), chunk_lines).alias("_chunk"),
        F.col(row).cast("bigint").alias("_row"),
        F.coalesce(text, F.lit("")).alias("_text"),
    ).withColumn("_starts", F.col("_text").rlike(start_pattern).cast("bigint"))


def _in_chunk() -> Window:
    window = Window.partitionBy(*_PLACE).orderBy("_row")
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before_chunk() -> Window:
    window = Window.partitionBy("_file").orderBy("_block", "_chunk")
    return window.rowsBetween(Window.unboundedPreceding, -1)


def label_lines(
    lines: DataFrame,
    start_pattern: str,
    file: str = "file_path",
    block: str = "block",
    row: str = "row",
    text: str = "value",
    chunk_lines: int = 4096,
) -> DataFrame:
    """Each line with its `entry` and its `line_in_entry`, from 0; nothing is gathered."""
    chunked = _chunked(lines, start_pattern, file, block, row, text, chunk_lines)
    index = F.count(F.lit(1)).over(_in_chunk()) - 1
    placed = chunked.withColumns({"_index": index, "_local": F.sum("_starts").over(_in_chunk())})
    own_start = F.max(F.when(F.col("_starts") == 1, F.col("_index"))).over(_in_chunk())
    placed = placed.withColumn("_own_start", own_start)
    sums = placed.groupBy(*_PLACE).agg(
        F.sum("_starts").alias("_n"),
        F.count(F.lit(1)).alias("_lines"),
        F.max(F.when(F.col("_starts") == 1, F.col("_index"))).alias("_last_start"),
    )
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_lines").over(_before_chunk()), F.lit(0)))
    bases = sums.select(
        *_PLACE,
        "_offset",
        F.coalesce(F.sum("_n").over(_before_chunk()), F.lit(0)).alias("_entries"),
        F.coalesce(F.max(F.col("_offset") + F.col("_last_start")).over(_before_chunk()), F.lit(0)).alias("_open"),
    )
    begun_before = F.col("_offset") + F.col("_index") - F.col("_open")
    return placed.join(bases, _PLACE).select(
        F.col("_file").alias(file),
        F.col("_block").alias(block),
        F.col("_row").alias(row),
        (F.col("_entries") + F.col("_local")).alias("entry"),
        F.coalesce(F.col("_index") - F.col("_own_start"), begun_before).alias("line_in_entry"),
        F.col("_text").alias(text),
    )


def entry_parts(
    lines: DataFrame,
    start_pattern: str,
    file: str = "file_path",
    block: str = "block",
    row: str = "row",
    text: str = "value",
    chunk_lines: int = 4096,
) -> DataFrame:
    """Entries of each file in parts of at most `chunk_lines` lines: file, entry, place, n_lines and part.

    Parts of an entry in order of `place`, with a line feed between them, are its text. Nothing is
    gathered beyond a part, so an entry may be longer than a row can be.
    """
    chunked = _chunked(lines, start_pattern, file, block, row, text, chunk_lines)
    bases = chunked.groupBy(*_PLACE).agg(F.sum("_starts").alias("_n")).select(
        *_PLACE, F.coalesce(F.sum("_n").over(_before_chunk()), F.lit(0)).alias("_entries")
    )
    fragments = (
        chunked.withColumn("_local", F.sum("_starts").over(_in_chunk()))
        .groupBy(*_PLACE, "_local")
        .agg(
            F.count(F.lit(1)).alias("_lines"),
            _joined(F.collect_list(F.struct("_row", F.col("_text").alias("text")))).alias("_text"),
        )
    )
    return fragments.join(bases, _PLACE).select(
        F.col("_file").alias(file),
        (F.col("_entries") + F.col("_local")).alias("entry"),
        F.struct("_block", "_chunk").alias("place"),
        F.col("_lines").alias("n_lines"),
        F.col("_text").alias("part"),
    )


def group_multiline(
    lines: DataFrame,
    start_pattern: str,
    file: str = "file_path",
    block: str = "block",
    row: str = "row",
    text: str = "value",
    chunk_lines: int = 4096,
) -> DataFrame:
    """Entries of each file: a line matching `start_pattern` starts one, others continue it.

    Lines before a file's first start form entry 0. Line order is (`block`, `row`). Every entry
    is one row, however long. Lines are shuffled by chunk and joined there into fragments of
    entries; only fragments are shuffled once more. Entries that are too long for a row or a
    task are kept apart by `entry_parts`, or line by line by `label_lines`.
    """
    parts = entry_parts(lines, start_pattern, file, block, row, text, chunk_lines)
    return parts.groupBy(file, "entry").agg(
        F.sum("n_lines").alias("n_lines"),
        _joined(F.collect_list(F.struct("place", F.col("part").alias("text")))).alias("message"),
    )
