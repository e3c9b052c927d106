"""Writing log rows to the partitioned table, or to one topic per service."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog import model
from tidelog.functions import timefmt
from tidelog.sources import wire


def with_time_partitions(logs: DataFrame) -> DataFrame:
    """Adds year, month, day, hour and minute of the ISO `timestamp`."""
    return logs.withColumns(timefmt.time_partitions(timefmt.epoch_seconds(F.col("timestamp"))))


def name_empty_services(logs: DataFrame, name: str = "unknown") -> DataFrame:
    """Gives rows without a service a name; an empty one would be read back as NULL."""
    service = F.col("service_name")
    return logs.withColumn(
        "service_name", F.when(F.length(service) > 0, service).otherwise(F.lit(name))
    )


def balance_for_write(rows: DataFrame, partition_columns: list[str]) -> DataFrame:
    """Brings the rows of a directory together without making a hot one a single task.

    Adaptive execution merges small shuffle partitions and splits large ones at
    `spark.sql.adaptive.advisoryPartitionSizeInBytes`, in batch and stateless streams.
    """
    return rows.hint("rebalance", *partition_columns)


def write_logs(
    rows: DataFrame,
    root: str,
    partition_columns: list[str] | None = None,
    compression: str = "gzip",
    max_records_per_file: int = 0,
    replace: bool = False,
) -> None:
    """Appends rows that have their partition columns, as one batch.

    With `replace` they take the place of what their partitions hold.
    """
    columns = partition_columns or model.PARTITION_COLUMNS
    (
        balance_for_write(rows, columns)
        .write.mode("overwrite" if replace else "append")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*columns)
        .parquet(root)
    )


def queue_rows(logs: DataFrame, prefix: str = model.TOPIC_PREFIX) -> DataFrame:
    """Topic and record bytes of log rows, as the queue sink takes them."""
    instant = timefmt.instant(F.col("timestamp"))
    fraction = F.rpad(F.substring("timestamp", F.lit(21), F.length("timestamp") - 21), 9, "0")
    level = F.col("log_level") if "log_level" in logs.columns else None
    encoded = wire.encode_records(
        route_topics(logs, prefix),
        F.col("service_name"),
        F.col("message"),
        level,
        F.unix_seconds(instant),
        fraction.try_cast("int"),
    )
    return encoded.select("topic", "value")


def start_queue_sink(
    logs: DataFrame, bootstrap_servers: str, checkpoint: str, compression: str = "zstd"
) -> StreamingQuery:
    """Starts the stream of log rows to one topic per service; needs the Kafka package."""
    return (
        queue_rows(logs)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("kafka.compression.type", compression)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def route_topics(logs: DataFrame, prefix: str = model.TOPIC_PREFIX) -> DataFrame:
    """Adds the topic of each row's service; the queue sink writes to the topic named there.

    Rows without a service, which read back as NULL, share the topic `unknown`.
    """
    service = F.when(F.length("service_name") > 0, F.col("service_name")).otherwise(F.lit("unknown"))
    return logs.withColumn("topic", F.concat(F.lit(prefix), service))
