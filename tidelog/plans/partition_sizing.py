"""Partition recommendations for the topics a job subscribes to."""

from pyspark.sql import DataFrame

from tidelog import model
from tidelog.operators import offsets


def recommend_partitions(
    end_offsets: DataFrame,
    pattern: str | None = model.TOPIC_PATTERN,
    per_partition: int = model.RATE_PER_PARTITION,
) -> DataFrame:
    """Topics, by snapshot, whose rate calls for more partitions than they have."""
    topics = offsets.matching_topics(end_offsets, pattern)
    sums = offsets.offset_sums(end_offsets.join(topics, "topic", "left_semi"))
    return offsets.partition_decisions(offsets.offset_rates(sums), per_partition).select(
        "topic", "captured_at", "rate", "partitions", "required_partitions"
    )
