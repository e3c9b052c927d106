"""Queries that run streams to their end and read what they stored."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.session import work_folder
from tidelog.sources import records, tables, wire
from tidelog.streaming import ingest, runs
from workload import derive
from workload.registry import query

_ROWS = f"WITH {derive.INGESTED} SELECT service_name, message, \"timestamp\", time FROM ingested"
_COUNTS = (
    f"WITH {derive.INGESTED} SELECT service_name, time, count(*) AS n, min(\"timestamp\") AS first_at, "
    "max(\"timestamp\") AS last_at FROM ingested GROUP BY service_name, time"
)


def _stored(spark, root: str) -> DataFrame:
    # Dead letters lie at the time of ingest.
    living = F.col("service_name") != model.DEAD_LETTER_SERVICE
    given = [F.when(living | F.col("service_name").isNull(), F.col(c)).alias(c) for c in ("timestamp", "time")]
    return tables.read_logs(spark, root).select("service_name", "message", *given)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("service_name", "time").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )


def _start(spark, source: str, root: str, name: str = "ingest", files: int | None = None):
    rows = ingest.ingest_rows(ingest.read_record_files(spark, source, files))
    return ingest.start_sink(
        rows, f"{root}/logs", f"{root}/checkpoint", name=name, trigger_seconds=None
    )


@query("a1_record_stream", _ROWS)
def stream_once(spark, sf):
    root = work_folder(spark, "stream")
    runs.run_streams({"ingest": lambda n: _start(spark, derive.wire_files(spark, sf), root, n)})
    return _stored(spark, f"{root}/logs")


@query("k1_processing_time", _COUNTS)
def _(spark, sf):
    root = work_folder(spark, "stream")
    rows = ingest.ingest_rows(ingest.read_record_files(spark, derive.wire_files(spark, sf)))
    query_ = ingest.start_sink(rows, f"{root}/logs", f"{root}/checkpoint", trigger_seconds=1)
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
    return _counted(_stored(spark, f"{root}/logs"))


@query("k2_restart_from_checkpoint", _COUNTS)
def _(spark, sf):
    """Two increments of the source, a run after each; nothing is stored twice."""
    root = work_folder(spark, "stream")
    records = derive.wire_rows(spark, sf)
    half = F.col("us") < derive.FIRST_MICROS + 15 * 60_000_000
    for part in (half, ~half):
        records.where(part).select("value").write.mode("append").parquet(f"{root}/source")
        runs.run_streams({"ingest": lambda n: _start(spark, f"{root}/source", root, n)})
    return _counted(_stored(spark, f"{root}/logs"))


@query("k3_admission_control", _COUNTS)
def _(spark, sf):
    """Two files per batch."""
    root = work_folder(spark, "stream")
    source = derive.wire_files(spark, sf)
    runs.run_streams({"ingest": lambda n: _start(spark, source, root, n, files=2)})
    return _counted(_stored(spark, f"{root}/logs"))


@query(
    "k4_run_chain",
    f"WITH {derive.INGESTED} SELECT 'ABC' AS tenant, 2 AS runs, count(*) AS input_records, "
    "'succeeded' AS status, true AS wrote, true AS timed FROM ingested",
)
def _(spark, sf):
    """Two runs on one checkpoint and their history; the second has nothing left to do."""
    root = work_folder(spark, "chain")
    source = derive.wire_files(spark, sf)
    runs.run_chain(
        spark,
        # The files hold fewer records than one trigger admits; each counts as a tenth of it.
        lambda admitted: _start(spark, source, root, files=max(1, 10 * admitted // model.ADMISSION_MAX)),
        lambda: 8,
        f"{root}/history",
        "ABC",
        f"{root}/logs",
        runs=2,
    )
    history = spark.read.schema(model.RUN_SCHEMA).parquet(f"{root}/history")
    return history.groupBy("tenant").agg(
        F.count(F.lit(1)).cast("int").alias("runs"),
        F.sum("input_records").alias("input_records"),
        F.min("status").alias("status"),
        (F.max("output_bytes") > 0).alias("wrote"),
        F.every(F.col("completion_time") >= F.col("submission_time")).alias("timed"),
    )


@query(
    "k5_run_time_limit",
    f"WITH {derive.INGESTED} SELECT 'timed out' AS status, count(*) AS n FROM ingested",
)
def _(spark, sf):
    """A stream that would go on is stopped when its time is up; a later run ends the work."""
    root = work_folder(spark, "stream")
    source = derive.wire_files(spark, sf)
    rows = ingest.ingest_rows(ingest.read_record_files(spark, source, 4))
    endless = runs.run_streams(
        {
            "ingest": lambda n: ingest.start_sink(
                rows, f"{root}/logs", f"{root}/checkpoint", n, trigger_seconds=1
            )
        },
        timeout_minutes=2 / 60,
    )
    runs.run_streams({"ingest": lambda n: _start(spark, source, root, n)})
    stored = tables.read_logs(spark, f"{root}/logs")
    status = F.lit(endless["ingest"]["status"])
    return stored.agg(F.count(F.lit(1)).alias("n")).select(status.alias("status"), "n")


@query(
    "k6_two_streams",
    f"WITH {derive.INGESTED} SELECT side, service_name, count(*) AS n FROM ingested, "
    "(SELECT unnest(['first', 'second']) AS side) GROUP BY side, service_name",
)
def _(spark, sf):
    root = work_folder(spark, "streams")
    source = derive.wire_files(spark, sf)
    sides = ("first", "second")
    runs.run_streams({s: lambda n: _start(spark, source, f"{root}/{n}", n) for s in sides})
    first, second = (
        tables.read_logs(spark, f"{root}/{s}/logs").withColumn("side", F.lit(s)) for s in sides
    )
    return first.unionByName(second).groupBy("side", "service_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k7_run_statistics",
    f"WITH {derive.INGESTED} SELECT count(*) AS input_records, 8 AS cores_used, 'succeeded' AS status, "
    "'ABC' AS tenant, true AS wrote FROM ingested",
)
def _(spark, sf):
    root = work_folder(spark, "stream")
    source = derive.wire_files(spark, sf)
    result = runs.run_streams({"ingest": lambda n: _start(spark, source, root, n, files=3)})
    row = runs.run_statistics(spark, result["ingest"], "ABC", 8, f"{root}/logs")
    return row.select(
        "input_records", "cores_used", "status", "tenant", (F.col("output_bytes") > 0).alias("wrote")
    )


@query("k8_late_rows", _COUNTS)
def _(spark, sf):
    """The later half arrives first; late rows land in their own partitions."""
    root = work_folder(spark, "stream")
    records = derive.wire_rows(spark, sf)
    late = F.col("us") < derive.FIRST_MICROS + 15 * 60_000_000
    for part in (~late, late):
        records.where(part).select("value").write.mode("append").parquet(f"{root}/source")
        runs.run_streams({"ingest": lambda n: _start(spark, f"{root}/source", root, n)})
    return _counted(_stored(spark, f"{root}/logs"))


def _record_log(spark, sf) -> tuple[str, int]:
    """Index of the record files, and how many records they have."""
    decoded = F.col("seconds")

    def write(root: str) -> None:
        # Each record with its time, as a producer knows it; the stream itself reads only the bytes.
        rows = wire.decode_records(derive.wire_rows(spark, sf)).select("us", "event_id", "value", decoded)
        placed = rows.repartitionByRange(5, "us", "event_id").sortWithinPartitions("us", "event_id").drop("us", "event_id")
        # Small row groups, as batches take few records from any place in a file.
        placed.write.option("parquet.block.size", 1 << 20).parquet(f"{root}/records")
        records.extend_index(spark, f"{root}/records", f"{root}/index", decoded)

    root = derive.once(spark, sf, "record-log", write)
    return f"{root}/index", records.extend_index(spark, f"{root}/records", f"{root}/index", decoded)


# Streams that share a log.
_SHARES = 8


def _run_log(spark, index: str, root: str, most: int, start: int, end: int, runs: int = 1) -> DataFrame:
    """Stores the rows of the log from `start` to `end`, each batch in a folder of its own; returns all stored rows.

    Batches are many and small, so each stream is planned with all its steps once, a batch is one job that
    reads its parts in one task and writes one file, and several streams, each with a checkpoint of its own,
    share the log. Later runs go on behind the checkpoints of earlier ones.
    """

    def begin(first: int, last: int):
        folder = f"{root}/logs/first={first}"

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

        source = records.read_record_log(spark, index, most, first, records_per_task=most // 3 + 1, ending_offset=last)
        writer = ingest.ingest_rows(source.coalesce(1)).writeStream.option("checkpointLocation", f"{root}/checkpoint/{first}")
        return writer.foreachBatch(write).start()

    shares = records.shares(start, end, most, _SHARES)
    for _ in range(runs):
        streams = []
        try:
            for share in shares:
                streams.append(begin(*share))
            for stream in streams:
                stream.processAllAvailable()
        finally:
            for stream in streams:
                stream.stop()
    if not shares:
        return spark.createDataFrame([], "service_name string, first string, batch string")
    return spark.read.parquet(f"{root}/logs")


@query(
    "k3_admitted_records",
    f"WITH {derive.INGESTED}, counted AS (SELECT service_name, count(*) AS n FROM ingested GROUP BY ALL), "
    "total AS (SELECT count(*) AS records FROM events) SELECT service_name, n, records, "
    "CAST((records + 699) // 700 AS BIGINT) AS batches, CAST(least(records, 700) AS BIGINT) AS most FROM counted, total",
)
def _(spark, sf):
    """Batches of 700 records, wherever files begin and end, over a restart in the middle."""
    index, n_records = _record_log(spark, sf)
    root = work_folder(spark, "admitted")
    stored = _run_log(spark, index, root, 700, 0, n_records, runs=2)
    sizes = stored.groupBy("first", "batch").agg(F.count(F.lit(1)).alias("n"))
    batches = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    rows = stored.groupBy("service_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        "service_name",
        "n",
        F.lit(n_records).cast("bigint").alias("records"),
        F.lit(batches["n"]).cast("bigint").alias("batches"),
        F.lit(batches["most"]).cast("bigint").alias("most"),
    )


_START_SECONDS = derive.FIRST_MICROS // 1_000_000 + 13 * 60 + 5


@query(
    "a3_start_by_time",
    f"""WITH {derive.DENSE}, numbered AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS number FROM dense),
first AS (SELECT min(number) AS number FROM numbered WHERE value >= 2 AND us // 1000000 >= {_START_SECONDS})
SELECT f.number AS first_offset, count(*) AS n FROM numbered n, first f WHERE n.number >= f.number GROUP BY ALL""",
)
def _(spark, sf):
    """A stream that begins at the first record at or after an instant."""
    index, n_records = _record_log(spark, sf)
    root = work_folder(spark, "since")
    start = records.offset_at(spark, index, _START_SECONDS, F.col("seconds"))
    stored = _run_log(spark, index, root, 1500, start, n_records)
    return stored.agg(F.count(F.lit(1)).alias("n")).select(F.lit(start).cast("bigint").alias("first_offset"), "n")
