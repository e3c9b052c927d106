"""Topic offsets: sums, rates between snapshots, needed partitions and consumer lag."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import sizing, timefmt
from tidelog.operators.adjacent import with_adjacent

_LOW_GAP, _HIGH_GAP = model.OFFSET_GAP_SECONDS


def matching_topics(offsets: DataFrame, pattern: str | None = model.TOPIC_PATTERN) -> DataFrame:
    """Distinct topics whose whole name matches; all without a pattern."""
    topics = offsets.where(F.col("topic").rlike(f"^(?:{pattern})$")) if pattern else offsets
    return topics.select("topic").distinct()


def offset_sums(offsets: DataFrame) -> DataFrame:
    """Sum of end offsets and number of partitions per topic and snapshot."""
    return offsets.groupBy("topic", "captured_at").agg(
        F.coalesce(F.sum("end_offset"), F.lit(0)).alias("sum_of_end_offsets"),
        F.count("partition").cast("int").alias("partitions"),
    )


def offsets_of_topics(topics: DataFrame, sums: DataFrame) -> DataFrame:
    """The sums of the asked topics; 0 and 0 for one that has none."""
    return topics.join(sums.drop("captured_at"), "topic", "left").na.fill(
        0, ["sum_of_end_offsets", "partitions"]
    )


def with_previous_snapshot(sums: DataFrame) -> DataFrame:
    """Each snapshot with the one before it of the same topic."""
    return with_adjacent(
        sums,
        ["topic"],
        "captured_at",
        {"previous_sum": "sum_of_end_offsets", "previous_at": "captured_at"},
        "lag",
        F.to_date("captured_at"),
    )


def offset_rates(sums: DataFrame) -> DataFrame:
    """Offset change and whole records per second since the previous snapshot.

    `valid` tells whether the gap suits a scaling decision: above 30 s, at most 300 s.
    """
    elapsed = timefmt.elapsed_seconds(
        F.unix_millis("previous_at"), F.unix_millis("captured_at")
    )
    gap = F.col("elapsed_seconds")
    return (
        with_previous_snapshot(sums)
        .withColumn("elapsed_seconds", elapsed)
        .withColumn("offset_delta", F.col("sum_of_end_offsets") - F.col("previous_sum"))
        .withColumn("rate", timefmt.int_div(F.col("offset_delta"), F.nullif(gap, F.lit(0))))
        .withColumn("valid", F.coalesce((gap > _LOW_GAP) & (gap <= _HIGH_GAP), F.lit(False)))
    )


def valid_samples(rates: DataFrame) -> DataFrame:
    return rates.where(F.col("valid"))


def partition_decisions(
    rates: DataFrame, per_partition: int = model.RATE_PER_PARTITION
) -> DataFrame:
    """Valid snapshots whose rate needs more partitions than the topic has."""
    return (
        valid_samples(rates)
        .withColumn("required_partitions", sizing.required_partitions(F.col("rate"), per_partition))
        .where(F.col("required_partitions") > F.col("partitions"))
    )


def consumer_lag(end_offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Lag per topic and its mean per partition; a partition without a commit lags in full."""
    behind = F.col("end_offset") - F.coalesce("committed_offset", F.lit(0))
    return (
        end_offsets.join(committed, ["topic", "partition"], "left")
        .groupBy("topic")
        .agg(
            F.sum(behind).alias("lag"),
            F.count(F.lit(1)).cast("int").alias("partitions"),
        )
        .withColumn("lag_per_partition", timefmt.int_div(F.col("lag"), F.col("partitions")))
    )
