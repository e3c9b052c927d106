"""The ingest stream: record bytes to log rows to the partitioned table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelog import model
from tidelog.sinks import logs
from tidelog.sources import wire


def read_record_files(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, value: str = "value"
) -> DataFrame:
    """Stream of record bytes from Parquet files, where there is no message queue."""
    reader = spark.readStream.schema(T.StructType([T.StructField(value, T.BinaryType())]))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def ingest_rows(
    records: DataFrame,
    on_corrupt: str = "dead_letter",
    on_missing_ts: str = "epoch",
    keep_log_level: bool = False,
    name_empty: str | None = None,
    native: bool | None = None,
) -> DataFrame:
    """Log rows with their partition columns, from record bytes; batch or stream."""
    rows = wire.log_rows(
        wire.decode_records(records, native=native),
        on_corrupt,
        on_missing_ts,
        keep_log_level,
        time_partitions=True,
    )
    return logs.name_empty_services(rows, name_empty) if name_empty else rows


def start_sink(
    rows: DataFrame,
    root: str,
    checkpoint: str,
    name: str = "application-logs-to-table",
    trigger_seconds: int | None = model.TRIGGER_SECONDS,
    partition_columns: list[str] | None = None,
    compression: str = "gzip",
    balanced: bool = True,
) -> StreamingQuery:
    """Starts the checkpointed append of `rows` to the table; each row lands exactly once.

    Rows go to the partition of their own time however late they come. Without
    `trigger_seconds` the query handles what is available, in batches of the source's
    admission size, and ends. `balanced` gathers each directory's rows into few files,
    for one shuffle.
    """
    columns = partition_columns or model.PARTITION_COLUMNS
    out = logs.balance_for_write(rows, columns) if balanced else rows
    writer = (
        out.writeStream.queryName(name)
        .format("parquet")
        .outputMode("append")
        .partitionBy(*columns)
        .option("compression", compression)
        .option("checkpointLocation", checkpoint)
    )
    if trigger_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start(root)
