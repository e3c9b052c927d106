"""Readers of the partitioned log table and the metadata tables."""

import re
from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import model
from tidelog.checks import is_missing_path, not_empty
from tidelog.functions import keys, timefmt



def read_logs(spark: SparkSession, root: str, extra: T.StructType | None = None) -> DataFrame:
    """The log table below `root` with its computed `time` column.

    Columns a file lacks are NULL. Reading the root of a streaming sink sees exactly the
    committed files. `extra` names further columns, such as `log_level` or `env`.
    """
    fields = [*model.TABLE_SCHEMA.fields, *(extra.fields if extra else [])]
    logs = spark.read.schema(T.StructType(fields)).parquet(root)
    return logs.withColumn("time", timefmt.partition_time_of_columns())


def read_logs_projected(
    spark: SparkSession,
    root: str,
    services: Sequence[str],
    start: datetime,
    end: datetime,
    extra: T.StructType | None = None,
) -> DataFrame:
    """The table's rows of some services and minutes, without listing the other directories.

    Directories follow from services and minute range, both ends included, and are
    listed only where they lie in that range. For tables written by batch jobs: a path
    below a streaming sink's root would not be checked against the sink's log, as
    `tiers.Tiered` does.
    """
    found = projected_parts(spark, root, services, start, end, extra)
    return found if found is not None else no_logs(spark, extra)


def no_logs(spark: SparkSession, extra: T.StructType | None = None) -> DataFrame:
    """No rows of the log table."""
    schema = T.StructType([*model.TABLE_SCHEMA.fields, *(extra.fields if extra else [])])
    return spark.createDataFrame([], schema).withColumn("time", timefmt.partition_time_of_columns())


def projected_parts(
    spark: SparkSession,
    root: str,
    services: Sequence[str],
    start: datetime,
    end: datetime,
    extra: T.StructType | None = None,
) -> DataFrame | None:
    """The rows of `read_logs_projected`, or None if there are no such directories."""
    not_empty("services", services)
    schema = T.StructType([*model.TABLE_SCHEMA.fields, *(extra.fields if extra else [])])
    names = ",".join(_directory_value(s) for s in dict.fromkeys(services))
    found = []
    for glob in minute_globs(start, end):
        try:
            found.append(
                spark.read.schema(schema)
                .option("basePath", root)
                .parquet(f"{root}/service_name={{{names}}}/{glob}")
            )
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
    if not found:
        return None
    logs = reduce(DataFrame.unionByName, found)
    return logs.withColumn("time", timefmt.partition_time_of_columns())


def _directory_value(value: str) -> str:
    """A partition value as its directory name, safe inside a glob's braces."""
    if not value:
        return model.NULL_PARTITION
    escaped = "".join(
        f"%{ord(c):02X}" if c in keys.ESCAPED_IN_PATHS or ord(c) < 32 else c for c in value
    )
    return re.sub(r"([,}])", r"\\\1", escaped)


def minute_globs(start: datetime, end: datetime) -> list[str]:
    """Folders of every minute from `start` to `end`, both included, and no other, as globs.

    Whole years, months, days and hours in between are named by their own folder, so that
    their number does not grow with the range; Spark lists what is below them in tasks.
    """
    at = start.replace(second=0, microsecond=0)
    last = end.replace(second=0, microsecond=0)
    stop = last + timedelta(minutes=1)
    spans: dict[tuple[str, str], list[str]] = {}
    while at < stop:
        level, following = _largest_unit(at, stop)
        parent, name = _directories(at, level)
        spans.setdefault((parent, level), []).append(name)
        at = following
    globs = []
    for (parent, level), names in spans.items():
        alternatives = names[0] if len(names) == 1 else "{" + ",".join(names) + "}"
        globs.append("/".join(p for p in [parent, f"{level}={alternatives}"] if p))
    return globs


def _largest_unit(at: datetime, stop: datetime) -> tuple[str, datetime]:
    """The largest whole unit starting at `at` and ending by `stop`, and where it ends."""
    midnight = at.hour == 0 and at.minute == 0
    candidates = []
    if midnight and at.day == 1:
        if at.month == 1:
            candidates.append(("year", at.replace(year=at.year + 1)))
        candidates.append(("month", (at + timedelta(days=32)).replace(day=1)))
    if midnight:
        candidates.append(("day", at + timedelta(days=1)))
    if at.minute == 0:
        candidates.append(("hour", at + timedelta(hours=1)))
    for level, following in candidates:
        if following <= stop:
            return level, following
    return "minute", at + timedelta(minutes=1)


def _directories(at: datetime, level: str) -> tuple[str, str]:
    """The directories above a unit's own, and its own value."""
    values = dict(
        year=f"{at.year}", month=f"{at.month:02d}", day=f"{at.day:02d}", hour=f"{at.hour:02d}", minute=f"{at.minute:02d}"
    )
    above = model.TIME_COLUMNS[: model.TIME_COLUMNS.index(level)]
    return "/".join(f"{f}={values[f]}" for f in above), values[level]


def tenant_rows(table: DataFrame, tenant: str) -> DataFrame:
    return table.where(F.col("tenant") == tenant)


def replay_from(logs: DataFrame, since: str) -> DataFrame:
    """Rows at or after an instant, given as ISO text with any offset.

    Partitions before the instant's minute are pruned where the rows have their `time`.
    """
    seconds, fraction = _parsed_instant(since)
    at = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    day = f"{at.year:04d}-{at:%m-%dT%H:%M:%S}"
    rows = logs.where(timefmt.instant_order(F.col("timestamp")) >= F.lit(day + fraction))
    if "time" in logs.columns:
        minute = f"year={at.year:04d}/" + f"{at:month=%m/day=%d/hour=%H/minute=%M}"
        rows = rows.where(F.col("time") >= F.lit(minute))
    return rows


_INSTANT = re.compile(
    r"(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,9})\d*)?)?([Zz]|[+-]\d{2}(?::?\d{2})?)"
)


def _parsed_instant(text: str) -> tuple[int, str]:
    """Epoch seconds of an ISO text, and nine digits of its fraction."""
    found = _INSTANT.fullmatch(text.strip())
    if not found:
        raise ValueError(f"{text!r} is not an ISO instant with an offset")
    date, minute, second, fraction, offset = found.groups()
    at = datetime.fromisoformat(f"{date}T{minute}:{second or '00'}")
    seconds = int((at - datetime(1970, 1, 1)) / timedelta(seconds=1))
    if offset not in "Zz":
        sign = -1 if offset[0] == "-" else 1
        digits = offset[1:].replace(":", "").ljust(4, "0")
        seconds -= sign * (int(digits[:2]) * 3600 + int(digits[2:]) * 60)
    return seconds, (fraction or "").ljust(9, "0")
