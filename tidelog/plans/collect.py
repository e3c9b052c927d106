"""What a collector does, from events or text lines to log rows; each for batches and streams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions import timefmt
from tidelog.operators import multiline, shaping

_ROW = ["service_name", "message", "timestamp"]


def event_rows(events: DataFrame, on_invalid: str = "drop") -> DataFrame:
    """Log rows of collected events.

    The message comes out of the body, the service out of the resources where they name one,
    and the time of observation is the event's time.
    """
    rows = shaping.normalise_message(events, on_invalid=on_invalid)
    rows = shaping.assign_event_time(shaping.enrich_service(rows))
    invalid = ["invalid"] if on_invalid == "quarantine" else []
    return rows.select(*_ROW, *invalid)


def line_rows(
    lines: DataFrame,
    pattern: str,
    service: str | Column,
    time_format: str = "yyyy-MM-dd HH:mm:ss",
    text: str = "value",
) -> DataFrame:
    """Log rows of text lines with the named groups `timestamp` and `message`.

    The time is read as UTC. A line that does not match, or whose time is none, is kept whole,
    with the time at which it is read.
    """
    parsed = shaping.parse_named_groups(lines.select(text), pattern, text, matched=None)
    at = F.try_to_timestamp(F.concat("timestamp", F.lit("Z")), F.lit(f"{time_format}X"))
    known = F.when(F.col("timestamp").isNotNull(), at)
    micros = F.unix_micros(F.coalesce(known, F.current_timestamp()))
    iso = timefmt.iso_instant(
        timefmt.int_div(micros - F.pmod(micros, F.lit(1_000_000)), 1_000_000), F.pmod(micros, F.lit(1_000_000)) * 1000
    )
    kept = parsed.select(F.col(text), F.col("message"), iso.alias("_at"), known.isNotNull().alias("_known"))
    return kept.select(
        (service if isinstance(service, Column) else F.lit(service)).alias("service_name"),
        F.when(F.col("_known"), F.col("message")).otherwise(F.col(text)).alias("message"),
        F.col("_at").alias("timestamp"),
    )


def start_entry_sink(
    lines: DataFrame, start_pattern: str, root: str, checkpoint: str, trigger_seconds: int | None = None
) -> StreamingQuery:
    """Starts a stream of text lines into entries of several lines, in a folder per batch.

    A file is read as a whole in one batch, so no entry goes on in another; a batch that is run
    again replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("row", F.monotonically_increasing_id())
        entries = multiline.group_multiline(placed, start_pattern)
        entries.write.mode("overwrite").parquet(f"{root}/batch={number}")

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if trigger_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{trigger_seconds} seconds").start()
