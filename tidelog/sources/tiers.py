"""A stream's table in two tiers: closed days in batch tables, later files as the sink committed them.

A streaming sink lists its committed files in its log. What lies in its folders besides, left by a
batch that failed, must not be read, and reading the root makes the driver load the whole
log. Here the log is read in tasks, like any other text, and only the files of the searched
services and minutes come back.

`close_until` moves the work on closed days out of the sink: rows of all committed files before a minute are
written once more, few files a directory, to a batch table of their own, with the list of the files they came
from. A table of such rollovers is changed by one committed version, so a rollover is seen whole or
not at all, and a lost job leaves a folder nobody names. A file that the sink commits later, for minutes
that are closed already, is in no rollover's list: it is read from the sink until the next one takes it.
"""

import uuid
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import model
from tidelog.functions import keys, timefmt
from tidelog.sinks import logs, versioned
from tidelog.sources import listing, tables

# The folder and the fields of a streaming sink's log.
SINK_LOG = "_spark_metadata"
_ENTRY = T.StructType([T.StructField("path", T.StringType()), T.StructField("action", T.StringType())])
ROLLOVER_SCHEMA = model.schema_of("name string, first string, last string, handover string, closed_at timestamp")


def is_stream_table(spark: SparkSession, root: str) -> bool:
    return not listing.list_hidden_folder(spark, f"{root}/{SINK_LOG}").isEmpty()


def _log_files(spark: SparkSession, root: str) -> list[str]:
    """The sink's latest compact file and the batches after it; Spark keeps these few."""
    found: dict[int, tuple[bool, str]] = {}
    for (path,) in listing.list_hidden_folder(spark, f"{root}/{SINK_LOG}").select("path").collect():
        number, _, kind = path.rsplit("/", 1)[-1].partition(".")
        if number.isdigit() and kind in ("", "compact"):
            found[int(number)] = max(found.get(int(number), (False, "")), (kind == "compact", path))
    first = max((n for n, (compact, _) in found.items() if compact), default=0)
    return [path for n, (_, path) in sorted(found.items()) if n >= first]


def committed_files(spark: SparkSession, root: str) -> DataFrame:
    """path, service_name and `time` of the files a streaming sink has committed."""
    paths = _log_files(spark, root)
    if not paths:
        entries = spark.createDataFrame([], _ENTRY)
    else:
        # Spark's own readers refuse a sink's log folder.
        lines = spark.sparkContext.textFile(",".join(paths))
        entries = spark.read.schema(_ENTRY).json(lines)
    added = entries.where(F.col("path").isNotNull() & (F.col("action") == "add"))
    # The log has URIs.
    path = keys.unescape(F.col("path"))
    return added.select(path.alias("path")).distinct().select(
        "path", _service(F.col("path")).alias("service_name"), keys.time_from_key(F.col("path")).alias("time")
    )


def _service(path: Column) -> Column:
    value = keys.service_from_key(path)
    return F.when(value != model.NULL_PARTITION, value)


def minute_text(at: datetime) -> str:
    """The `time` of a minute."""
    return f"year={at.year:04d}/" + f"{at:month=%m/day=%d/hour=%H/minute=%M}"


def _rollovers(spark: SparkSession, closed: str) -> DataFrame:
    return versioned.read_table(spark, f"{closed}/rollovers", ROLLOVER_SCHEMA)


def close_until(spark: SparkSession, root: str, closed: str, until: datetime) -> str | None:
    """Makes a rollover of all committed files before the minute `until` that are in none yet.

    Returns its name, or None if there was nothing to close. Run by one job at a time; of two the
    second fails when it commits, and its folder stays unnamed.
    """
    version = versioned.current_version(spark, f"{closed}/rollovers")
    rollovers = _rollovers(spark, closed)
    before = [r["name"] for r in rollovers.select("name").collect()]
    files = committed_files(spark, root).where(F.col("time") < minute_text(until))
    if before:
        done = spark.read.parquet(*(f"{closed}/files/{name}" for name in before))
        files = files.join(done, "path", "left_anti")
    name = uuid.uuid4().hex
    files.select("path", "service_name", "time").write.parquet(f"{closed}/files/{name}")
    files = spark.read.parquet(f"{closed}/files/{name}")
    bounds = files.agg(F.min("time").alias("first"), F.max("time").alias("last")).first()
    if bounds["first"] is None:
        return None
    rows = _rows_of(spark, root, [r["path"] for r in files.select("path").collect()])
    logs.write_logs(rows.drop("time"), f"{closed}/rows/{name}")
    row = spark.createDataFrame(
        [(name, bounds["first"], bounds["last"], minute_text(until))], "name string, first string, last string, handover string"
    )
    row = row.withColumn("closed_at", F.current_timestamp())
    versioned.replace_table(rollovers.unionByName(row), f"{closed}/rollovers", derived_from=version)
    return name


def _rows_of(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    found = spark.read.schema(model.TABLE_SCHEMA).option("basePath", root).parquet(*paths)
    return found.withColumn("time", timefmt.partition_time_of_columns())


class Tiered:
    """Committed rows of a table by service and minute, whether a stream or batches write it."""

    def __init__(self, spark: SparkSession, root: str, closed: str | None = None):
        self.spark, self.root, self.closed = spark, root, closed
        self.streamed = is_stream_table(spark, root)
        self.rollovers = _rollovers(spark, closed).collect() if closed else []
        self.open = self._open_files() if self.streamed else None

    def _open_files(self) -> DataFrame:
        files = committed_files(self.spark, self.root)
        if not self.rollovers:
            return files
        done = self.spark.read.parquet(*(f"{self.closed}/files/{r['name']}" for r in self.rollovers))
        handover = max(r["handover"] for r in self.rollovers)
        # Only files of closed minutes can be in a rollover.
        late = files.where(F.col("time") < handover).join(done.select("path"), "path", "left_anti")
        return files.where(F.col("time") >= handover).unionByName(late.select(*files.columns))

    def read(self, services: Sequence[str], start: datetime, end: datetime) -> DataFrame | None:
        """Rows of some services and minutes, both ends included; None if there are none."""
        if not self.streamed:
            return tables.projected_parts(self.spark, self.root, services, start, end)
        first, last = minute_text(start), minute_text(end)
        named = F.col("service_name").isin(*services)
        if "" in services:
            named |= F.col("service_name").isNull()
        wanted = self.open.where(named & F.col("time").between(first, last)).select("path")
        paths = [r["path"] for r in wanted.collect()]
        found = [_rows_of(self.spark, self.root, paths)] if paths else []
        for r in self.rollovers:
            if r["first"] <= last and first <= r["last"]:
                part = tables.projected_parts(self.spark, f"{self.closed}/rows/{r['name']}", services, start, end)
                found += [part] if part is not None else []
        return reduce(DataFrame.unionByName, found) if found else None

    def read_all(self, services: Sequence[str], start: datetime, end: datetime) -> DataFrame:
        """The same, with no rows in place of None."""
        found = self.read(services, start, end)
        return found if found is not None else tables.no_logs(self.spark)
