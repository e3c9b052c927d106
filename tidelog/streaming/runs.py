"""Bounded runs of one or several streams, their time limit and their statistics."""

import time
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog import model
from tidelog.functions import sizing
from tidelog.sinks import versioned

def _collect_progress(query: StreamingQuery, batches: dict[int, dict]) -> None:
    """Keeps progress by batch, as the query itself remembers only the latest ones."""
    for progress in query.recentProgress:
        if progress.numInputRows > 0:
            batches[progress.batchId] = {
                "rows": progress.numInputRows,
                "start": progress.timestamp,
                "millis": progress.durationMs.get("triggerExecution", 0),
            }


def run_streams(
    streams: Mapping[str, Callable[[str], StreamingQuery]],
    timeout_minutes: float = model.RUN_TIMEOUT_MINUTES,
    poll_seconds: float = 0.2,
) -> dict[str, dict]:
    """Starts the named streams, waits until all have ended or the time is up, stops them.

    Returns per name the status (`succeeded`, `timed out`) and the progress of its
    batches. A failing stream stops the others and its error is raised.
    """
    deadline = time.monotonic() + timeout_minutes * 60
    queries: dict[str, StreamingQuery] = {}
    batches: dict[str, dict[int, dict]] = {name: {} for name in streams}
    try:
        for name, start in streams.items():
            queries[name] = start(name)
        while any(q.isActive for q in queries.values()) and time.monotonic() < deadline:
            for name, query in queries.items():
                query.awaitTermination(poll_seconds)
                _collect_progress(query, batches[name])
        status = {n: "timed out" if q.isActive else "succeeded" for n, q in queries.items()}
    finally:
        for name, query in queries.items():
            _collect_progress(query, batches[name])
            if query.isActive:
                query.stop()
    for query in queries.values():
        if query.exception() is not None:
            raise query.exception()
    return {n: {"status": status[n], "batches": batches[n]} for n in streams}


def _millis(iso: str) -> int:
    at = datetime.fromisoformat(iso.replace("Z", "+00:00"))
    return int(at.astimezone(timezone.utc).timestamp() * 1000)


def committed_files(spark: SparkSession, root: str, since_millis: int) -> DataFrame:
    """Files a streaming sink has committed since an instant, and their sizes.

    Spark takes the files from the sink's log and opens only those recent enough.
    """
    recent = F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(since_millis))
    return (
        spark.read.schema(model.TABLE_SCHEMA)
        .parquet(root)
        .where(recent)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.max("_metadata.file_size").alias("length"))
    )


def run_statistics(
    spark: SparkSession,
    result: Mapping,
    tenant: str,
    cores_used: int | None = None,
    sink_root: str | None = None,
) -> DataFrame:
    """The history row of one finished stream: records, bytes, start, end, cores, status."""
    batches = list(result["batches"].values())
    starts = [_millis(b["start"]) for b in batches]
    ends = [s + b["millis"] for s, b in zip(starts, batches)]
    submission, completion = min(starts, default=0), max(ends, default=0)
    if sink_root is None or not batches:
        written = spark.range(1).select(F.lit(None if batches else 0).cast("bigint").alias("output_bytes"))
    else:
        files = committed_files(spark, sink_root, submission)
        written = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("output_bytes"))
    return written.select(
        "output_bytes",
        F.lit(sum(b["rows"] for b in batches)).cast("bigint").alias("input_records"),
        F.lit(submission).cast("bigint").alias("submission_time"),
        F.lit(completion).cast("bigint").alias("completion_time"),
        F.lit(cores_used).cast("int").alias("cores_used"),
        F.lit(result["status"]).alias("status"),
        F.lit(tenant).alias("tenant"),
        F.current_timestamp().alias("created_at"),
    )


def run_chain(
    spark: SparkSession,
    start: Callable[[int], StreamingQuery],
    cores: Callable[[], int | None],
    history_root: str,
    tenant: str,
    sink_root: str,
    runs: int = 1,
    timeout_minutes: float = model.RUN_TIMEOUT_MINUTES,
) -> None:
    """Bounded runs one after another, each with its own admission size and history row.

    `start` takes the number of records to admit per trigger and starts a query that
    ends by itself; `cores` tells how many are in use at that moment.
    """
    for _ in range(runs):
        used = cores()
        admitted = sizing.admission_records(used)
        result = run_streams({"run": lambda _: start(admitted)}, timeout_minutes)["run"]
        versioned.append_rows(
            run_statistics(spark, result, tenant, used, sink_root), history_root
        )
