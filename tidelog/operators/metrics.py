"""Metrics derived from log rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import timefmt


def log_counts(
    logs: DataFrame, level: Column, width: str = "1 minute", late_by: str | None = None
) -> DataFrame:
    """Rows per service, level and time window.

    `late_by` sets the watermark of a stream: a window is final that long after its end, and
    rows that come later still are in no count. Without it every row counts, in the modes
    `update` and `complete`, and the windows' state grows with the stream.
    """
    timed = logs.withColumn("event_time", timefmt.instant(F.col("timestamp"))).withColumn(
        "level", level
    )
    if late_by:
        timed = timed.withWatermark("event_time", late_by)
    return (
        timed.groupBy(F.window("event_time", width), "service_name", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "service_name",
            "level",
            "n",
        )
    )


def drop_repeats(logs: DataFrame, late_by: str) -> DataFrame:
    """Drops repeated rows of an at-least-once feed that arrive within `late_by` of each other.

    Only the time of arrival counts, so a row is never too late to be kept, however old it is;
    a repetition after more than `late_by` is kept as well.
    """
    if not logs.isStreaming:
        return logs.dropDuplicates()
    timed = logs.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", late_by)
    return timed.dropDuplicatesWithinWatermark(logs.columns).drop("_arrival")
