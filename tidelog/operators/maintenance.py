"""Retention, small files and the files that hold stream state. Nothing is deleted here."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import model
from tidelog.functions import keys
from tidelog.sinks.logs import write_logs
from tidelog.sources.tables import read_logs


def expired_partitions(
    objects: DataFrame,
    catalog: DataFrame,
    today: Column,
    default_days: int = model.DEFAULT_RETENTION_DAYS,
    kept_services: Sequence[str] = (model.DEAD_LETTER_SERVICE,),
) -> DataFrame:
    """Days of a service past its retention, with what a cleanup would free. A report only.

    Services the catalogue lacks have the retention of their environment (`env=` in the
    key) or the default one. Dead letters are kept, and so are rows without a time, which
    lie on the first day of the epoch.
    """
    path = F.col("path")
    day = keys.date_of_day(F.col("_day"))
    stored = (
        objects.groupBy(
            keys.service_from_key(path).alias("service_name"),
            keys.env_from_key(path).alias("_env"),
            keys.day_from_key(path).alias("_day"),
        )
        .agg(F.count(F.lit(1)).alias("_objects"), F.sum("length").alias("_bytes"))
        .where(~F.coalesce(F.col("service_name").isin(*kept_services), F.lit(False)))
        .withColumn("day", day)
        .where(F.col("day") > F.lit("1970-01-01").cast("date"))
    )
    days = catalog.groupBy("service_name").agg(F.max("retention_days").alias("_days"))
    kept_days = F.coalesce("_days", retention_of_env(F.col("_env"), default_days))
    return (
        stored.join(days, "service_name", "left")
        .withColumn("retention_days", kept_days)
        .where(F.col("day") < F.date_sub(today, F.col("retention_days")))
        .groupBy("service_name", "day", "retention_days")
        .agg(F.sum("_objects").alias("objects"), F.sum("_bytes").alias("bytes"))
        .select("service_name", "day", "objects", "bytes", "retention_days")
    )


def retention_of_env(env: Column, default_days: int = model.DEFAULT_RETENTION_DAYS) -> Column:
    """Retention by environment, the default for one without a rule."""
    rule = F.create_map(*[F.lit(x) for pair in model.ENV_RETENTION_DAYS.items() for x in pair])
    return F.coalesce(F.element_at(rule, env), F.lit(default_days))


def partition_sizes(objects: DataFrame) -> DataFrame:
    """Files and bytes per partition directory."""
    directory = F.regexp_replace("path", "/[^/]*$", "")
    return objects.groupBy(directory.alias("directory")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def small_file_partitions(
    objects: DataFrame, target_bytes: int = 128_000_000, min_files: int = 2
) -> DataFrame:
    """Partitions with more files than their bytes need at the target size."""
    needed = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(target_bytes)))
    return (
        partition_sizes(objects)
        .withColumn("needed_files", needed.cast("bigint"))
        .where((F.col("files") >= min_files) & (F.col("files") > F.col("needed_files")))
    )


def compact_table(
    spark: SparkSession,
    root: str,
    target: str,
    days: Sequence[tuple[str, str, str]] | None = None,
    max_records_per_file: int = 0,
) -> None:
    """Rewrites the table, or some (year, month, day) of it, with few files per partition.

    The result goes to a table of its own: files rewritten below a streaming sink's root
    would be unknown to the sink's log. It has all columns of the table, whichever of its
    files they are in, and replaces the partitions it writes, so that a second run leaves
    the same rows.
    """
    own = spark.read.option("mergeSchema", "true").parquet(root).schema
    extra = T.StructType([f for f in own.fields if f.name not in model.TABLE_SCHEMA.fieldNames()])
    logs = read_logs(spark, root, extra).drop("time")
    if days:
        day = F.struct("year", "month", "day")
        logs = logs.where(day.isin([F.struct(*map(F.lit, d)) for d in days]))
    write_logs(logs, target, max_records_per_file=max_records_per_file, replace=True)


def sink_log_files(objects: DataFrame, folder: str = "_spark_metadata") -> DataFrame:
    """Files of a sink's log with their number; other files of the folder are left out."""
    name = F.trim(F.substring_index("path", f"{folder}/", -1))
    return (
        objects.where(F.col("path").contains(f"{folder}/"))
        .withColumn("name", name)
        .where(keys.is_sink_log_name(F.col("name")))
        .withColumn("number", keys.sink_log_number(F.col("name")))
    )


def latest_sink_log(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Name and number of the newest log file, per group, and whether it is a compacted one."""
    order = F.struct("number", F.col("name").endswith(".compact"))
    return files.groupBy(*by).agg(
        F.max_by("name", order).alias("name"), F.max("number").alias("number")
    ).withColumn("compacted", F.col("name").contains(".compact"))


def stream_state_files(checkpoint_objects: DataFrame, sink_log_objects: DataFrame) -> DataFrame:
    """All files that hold a stream's state: its checkpoint and its sink's log."""
    return checkpoint_objects.withColumn("kind", F.lit("checkpoint")).unionByName(
        sink_log_objects.withColumn("kind", F.lit("sink_log"))
    )
