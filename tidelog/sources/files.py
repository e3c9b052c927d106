"""Line-based log files: raw text, JSON lines and syslog lines, as batch or stream."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import model
from tidelog.checks import one_of
from tidelog.functions import timefmt

# Syslog severity names by number, and the two line formats.
SEVERITIES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
_WORD = r"([^\s\x01]+)"
SYSLOG_BSD = (
    rf"^<(\d{{1,3}})>([A-Z][a-z]{{2}} [ \d]\d \d{{2}}:\d{{2}}:\d{{2}}) {_WORD} "
    r"([^\s:\[\x01]+)(?:\[(\d+)\])?: ?(.*)$"
)
SYSLOG_IETF = (
    rf"^<(\d{{1,3}})>1 {_WORD} {_WORD} {_WORD} {_WORD} {_WORD} "
    r"(-|(?:\[(?:[^\]\"\x01]|\"(?:[^\"\\\x01]|\\.)*\")*\])+)(?: (.*))?$"
)


def read_text_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    stream: bool = False,
    modified_since: str | None = None,
    line_separator: str | None = None,
    **options: str,
) -> DataFrame:
    """Lines of plain or gzip files with their file and their place in it.

    `paths` takes globs. `modified_since` (a timestamp text) skips older files, the
    counterpart of following logs from their end. Large plain files are read in splits:
    `block` is the split's offset and `row` rises with the lines of a split, so
    (`file_path`, `block`, `row`) is line order without reading a file in one task. A
    stream reads each file once, when it appears: lines appended to it later are not seen,
    so files must be complete when they are put in place.
    """
    options.setdefault("recursiveFileLookup", "true")
    if line_separator:
        options["lineSep"] = line_separator
    reader = (spark.readStream if stream else spark.read).options(**options)
    if stream:
        if not isinstance(paths, str):
            raise ValueError("a stream takes one path or glob")
        lines = reader.text(paths)
    else:
        lines = reader.text([paths] if isinstance(paths, str) else list(paths))
    columns = [
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
    ]
    if modified_since:
        lines = lines.where(
            F.col("_metadata.file_modification_time") >= F.lit(modified_since).cast("timestamp")
        )
    if not stream:
        columns.append(F.monotonically_increasing_id().alias("row"))
    return lines.select(*columns, "value")


def number_lines(lines: DataFrame, chunk_lines: int = 65_536) -> DataFrame:
    """Adds `line_no`, counted from 0 in each file.

    Lines are counted per chunk of a split first; only those counts are summed up in file
    order, so neither a huge file nor an unsplittable one ends up in one task.
    """
    place = ["file_path", "block", "_chunk"]
    chunked = lines.withColumn("_chunk", timefmt.int_div(F.col("row"), chunk_lines))
    counts = chunked.groupBy(*place).agg(
        F.count(F.lit(1)).alias("_lines"), F.min("row").alias("_first")
    )
    before = (
        Window.partitionBy("file_path")
        .orderBy("block", "_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = F.coalesce(F.sum("_lines").over(before), F.lit(0))
    starts = counts.select(*place, (earlier - F.col("_first")).alias("_shift"))
    return (
        chunked.join(starts, place, "left")
        .withColumn("line_no", F.col("row") + F.col("_shift"))
        .select(*lines.columns, "line_no")
    )


def read_raw_lines(spark: SparkSession, paths: str | Sequence[str], **kwargs) -> DataFrame:
    """Each line, unparsed, is a message."""
    return read_text_lines(spark, paths, **kwargs).withColumnRenamed("value", "message")


def parse_json_lines(
    lines: DataFrame, schema: T.StructType, text: str = "value", corrupt: str = "corrupt_record"
) -> DataFrame:
    """The fields of JSON lines; a line that is no such object is kept in `corrupt`."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(
        text, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    )
    return lines.withColumn("_parsed", parsed).select(
        *[c for c in lines.columns if c != text], "_parsed.*"
    )


def read_json_lines(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, **kwargs
) -> DataFrame:
    return parse_json_lines(read_text_lines(spark, paths, **kwargs), schema)


def _groups(text: Column, pattern: str, numbers: Sequence[int]) -> Column:
    """Some groups of an anchored pattern as an array, NULL where the text does not match.

    All come from one replacement, not from one search per group.
    """
    joined = F.regexp_replace(text, pattern, "\x01".join(f"${n}" for n in numbers))
    return F.when(text.rlike(pattern), F.split(joined, "\x01", len(numbers)))


def parse_syslog(
    lines: DataFrame,
    text: str = "value",
    max_bytes: int = model.SYSLOG_MAX_BYTES,
    on_oversized: str = "flag",
) -> DataFrame:
    """Fields and message of syslog lines: also message id and structured data where given.

    Both common line formats are read; a line in neither keeps its text as message and
    has `parsed` false. Lines above `max_bytes` are whole and `oversized`; only with
    `on_oversized='drop'` they are left out, as a receiver of that buffer size would.
    """
    one_of("on_oversized", on_oversized, {"drop", "flag"})
    line = F.col(text)
    oversized = F.octet_length(line) > max_bytes
    lines = lines.withColumn("oversized", oversized) if on_oversized == "flag" else lines.where(~oversized)
    # Priority, time, host, application, process, message id, structured data, message.
    bsd = _groups(line, SYSLOG_BSD, [1, 2, 3, 4, 5, 6])
    nothing = F.array(F.lit(""), F.lit(""))
    groups = F.coalesce(
        _groups(line, SYSLOG_IETF, [1, 2, 3, 4, 5, 6, 7, 8]),
        F.concat(F.slice(bsd, 1, 5), nothing, F.slice(bsd, 6, 1)),
    )
    kept = [c for c in lines.columns if c != text]
    lines = lines.withColumn("_groups", groups)

    def given(index: int) -> Column:
        value = F.get("_groups", F.lit(index))
        return F.when(~value.isin("", "-"), value)

    priority = given(0).cast("int")
    severity = F.get(F.array(*map(F.lit, SEVERITIES)), priority % 8)
    return lines.select(
        *kept,
        timefmt.int_div(priority, 8).cast("int").alias("facility"),
        F.when(priority.isNotNull(), severity).alias("severity"),
        given(1).alias("syslog_time"),
        given(2).alias("hostname"),
        given(3).alias("app_name"),
        given(4).alias("process_id"),
        given(5).alias("message_id"),
        given(6).alias("structured_data"),
        F.coalesce(F.get("_groups", F.lit(7)), line).alias("message"),
        F.col("_groups").isNotNull().alias("parsed"),
    )


def read_syslog_lines(spark: SparkSession, paths: str | Sequence[str], **kwargs) -> DataFrame:
    return parse_syslog(read_text_lines(spark, paths, **kwargs))
