"""Streams against the batch result of the same records."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.operators import metrics
from tidelog.sinks import logs as sink
from tidelog.sources import files, listing, tables, wire
from tidelog.streaming import ingest, runs

T0 = 1704067200


def records(spark, *rows):
    """Record bytes of (service, message, seconds, nanos); None as service cuts the record."""
    df = spark.createDataFrame(
        [(s or "s", m, t, n, s is None) for s, m, t, n in rows],
        "s string, m string, t bigint, n int, cut boolean",
    )
    df = wire.encode_records(df, F.col("s"), F.col("m"), None, F.col("t"), F.col("n"), value="v")
    cut = F.substring(F.col("v"), F.lit(1), F.octet_length("v") - 1)
    return df.select(F.when(F.col("cut"), cut).otherwise(F.col("v")).alias("value"))


ROWS = [
    ("api", "one", T0 + 1, 0),
    ("api", "two", T0 + 61, 500_000_000),
    ("web", "three", T0 + 86_399, 123_456_789),
    ("web", "no time", None, None),
    (None, "no service", T0, 1),
]
LATE = [("api", "late", T0 - 86_400, 0), ("api", "four", T0 + 5, 0)]


def start(spark, source, root, name="ingest", files_per_batch=None, trigger=None, **kwargs):
    rows = ingest.ingest_rows(ingest.read_record_files(spark, source, files_per_batch), **kwargs)
    return ingest.start_sink(rows, f"{root}/logs", f"{root}/checkpoint", name, trigger_seconds=trigger)


def run(spark, source, root, **kwargs):
    return runs.run_streams({"ingest": lambda n: start(spark, source, root, n, **kwargs)})["ingest"]


COLUMNS = ["message", "timestamp", "service_name", *model.TIME_COLUMNS]


def fixed(rows):
    """Sorted rows; dead letters lie at the time of ingest, which is not compared."""
    dead = model.DEAD_LETTER_SERVICE
    return sorted((r[0], r[2]) if r[2] == dead else tuple(r) for r in rows)


def stored(spark, root):
    return fixed(tables.read_logs(spark, f"{root}/logs").select(*COLUMNS).collect())


def batch(spark, *rows):
    time_columns = [F.col(c).cast("string") for c in model.TIME_COLUMNS]
    df = ingest.ingest_rows(records(spark, *rows)).select(*COLUMNS[:3], *time_columns)
    return fixed(df.collect())


def test_a_far_timestamp_does_not_end_ingest(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path)
    records(spark, ("api", "micros", 1609459200000000, 0), *ROWS[:2]).write.parquet(source)
    assert run(spark, source, root)["status"] == "succeeded"
    rows = tables.read_logs(spark, f"{root}/logs").collect()
    assert sorted(r.service_name for r in rows) == [model.DEAD_LETTER_SERVICE, "api", "api"]


def test_no_row_is_too_late_for_deduplication(spark, tmp_path):
    schema = model.schema_of("message string, timestamp string, service_name string")
    days = ["2024-01-09", "2024-01-01", "2024-01-09", "2023-01-01"]
    for i, day in enumerate(days):
        row = (f"m{day}", f"{day}T00:00:00Z", "s")
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    query = (
        metrics.drop_repeats(reader.parquet(f"{tmp_path}/in"), "1 hour").writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    assert sorted(r.message for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted({f"m{d}" for d in days})


def test_increments_restart_and_late_rows_equal_one_batch(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path)
    records(spark, *ROWS).write.parquet(source)
    first = run(spark, source, root)
    assert first["status"] == "succeeded"
    assert sum(b["rows"] for b in first["batches"].values()) == len(ROWS)
    assert stored(spark, root) == batch(spark, *ROWS)
    assert run(spark, source, root)["batches"] == {}
    records(spark, *LATE).write.mode("append").parquet(source)
    run(spark, source, root)
    assert stored(spark, root) == batch(spark, *ROWS, *LATE)
    late = [r for r in stored(spark, root) if r[0] == "late"]
    assert late[0][3:6] == ("2023", "12", "31")


def test_partitions_of_the_examples(spark):
    got = {r[0]: r[1:] for r in batch(spark, *ROWS)}
    assert got["two"] == ("2024-01-01T00:01:01.500Z", "api", "2024", "01", "01", "00", "01")
    assert got["three"][0] == "2024-01-01T23:59:59.123456789Z" and got["three"][5:] == ("23", "59")
    assert got["no time"] == ("1970-01-01T00:00:00Z", "web", "1970", "01", "01", "00", "00")


def test_uncommitted_files_are_not_read(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path)
    records(spark, *ROWS).write.parquet(source)
    run(spark, source, root)
    stray = f"{root}/logs/service_name=api/year=2024/month=01/day=01/hour=00/minute=00"
    spark.range(1).select(F.lit("stray").alias("message")).write.mode("append").parquet(stray)
    assert "stray" not in {r[0] for r in stored(spark, root)}


def test_corrupt_record_can_end_the_stream(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path)
    records(spark, *ROWS).write.parquet(source)
    with pytest.raises(Exception, match="corrupt log record"):
        run(spark, source, root, on_corrupt="fail")


def test_admission_size_bounds_a_batch(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path)
    for row in ROWS:
        records(spark, row).coalesce(1).write.mode("append").parquet(source)
    batches = run(spark, source, root, files_per_batch=1)["batches"]
    assert {b["rows"] for b in batches.values()} == {1} and len(batches) == len(ROWS)


def test_run_is_stopped_when_its_time_is_up(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path)
    records(spark, *ROWS).write.parquet(source)
    begin = time.monotonic()
    result = runs.run_streams(
        {"endless": lambda n: start(spark, source, root, n, trigger=1)}, timeout_minutes=8 / 60
    )["endless"]
    assert result["status"] == "timed out" and time.monotonic() - begin < 60
    assert not spark.streams.active


def test_failing_stream_stops_the_others(spark, tmp_path):
    source = str(tmp_path / "source")
    records(spark, *ROWS).write.parquet(source)
    streams = {
        "good": lambda n: start(spark, source, str(tmp_path / n), n, trigger=1),
        "bad": lambda n: start(spark, source, str(tmp_path / n), n, on_corrupt="fail"),
    }
    with pytest.raises(Exception, match="corrupt log record"):
        runs.run_streams(streams, timeout_minutes=1)
    assert not spark.streams.active


def test_chain_of_runs_keeps_history(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path)
    records(spark, *ROWS).write.parquet(source)
    cores, admitted = iter([None, 1000]), []

    def begin(n):
        if admitted:
            records(spark, *LATE).write.mode("append").parquet(source)
        admitted.append(n)
        return start(spark, source, root)

    runs.run_chain(spark, begin, lambda: next(cores), f"{root}/history", "ABC", f"{root}/logs", runs=2)
    history = spark.read.schema(model.RUN_SCHEMA).parquet(f"{root}/history").orderBy("submission_time").collect()
    assert admitted == [750_000_000, 1_100_000_000]
    assert [(r.input_records, r.cores_used, r.status) for r in history] == [
        (len(ROWS), None, "succeeded"), (len(LATE), 1000, "succeeded"),
    ]
    sizes = [os.path.getsize(re.sub("^file:/+", "/", r.path)) for r in runs.committed_files(spark, f"{root}/logs", 0).collect()]
    assert sum(r.output_bytes for r in history) == sum(sizes) > 0
    assert all(r.completion_time > r.submission_time > 0 for r in history)


def test_sink_log_is_listed(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path)
    records(spark, *ROWS).write.parquet(source)
    run(spark, source, root)
    names = {r.path.rsplit("/", 1)[1] for r in listing.list_hidden_folder(spark, f"{root}/logs/_spark_metadata").collect()}
    assert names == {"0"}
    assert listing.list_hidden_folder(spark, f"{root}/absent").count() == 0


@pytest.mark.parametrize("streamed", [False, True])
def test_hot_directory_is_written_by_several_tasks(spark, tmp_path, streamed):
    """One directory with nearly all rows becomes several files, the others few."""
    source, root = str(tmp_path / "source"), str(tmp_path / "logs")
    noise = F.sha2(F.col("id").cast("string"), 512)
    hot = F.when(F.col("id") % 50 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise(F.lit("hot"))
    spark.range(0, 40_000, 1, 8).select(
        F.concat(noise, noise).alias("message"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        hot.alias("service_name"),
    ).write.parquet(source)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200000")
    try:
        if streamed:
            rows = sink.with_time_partitions(spark.readStream.schema(model.INGEST_SCHEMA).parquet(source))
            runs.run_streams(
                {"hot": lambda n: ingest.start_sink(rows, root, f"{tmp_path}/cp", n, trigger_seconds=None)}
            )
        else:
            sink.write_logs(sink.with_time_partitions(spark.read.parquet(source)), root)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    service = F.regexp_extract("path", "service_name=([^/]*)", 1).alias("s")
    counts = {r.s: r["count"] for r in listing.list_objects(spark, root).groupBy(service).count().collect()}
    # A directory that shares the hot one's hash partition is split along with it.
    hot_files = counts.pop("hot")
    assert hot_files > 3 and 1 in counts.values() and set(counts.values()) <= {1, hot_files}
    assert tables.read_logs(spark, root).count() == 40_000


def test_text_files_stream_into_the_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-15 10:30:45 - hello\nno match\n")
    lines = files.read_text_lines(spark, str(tmp_path / "in"), stream=True)
    rows = lines.select(
        F.col("value").alias("message"),
        F.lit("2024-01-15T10:30:45Z").alias("timestamp"),
        F.regexp_extract("file_name", r"^(\w+)", 1).alias("service_name"),
    )
    runs.run_streams(
        {
            "text": lambda n: ingest.start_sink(
                sink.with_time_partitions(rows), f"{tmp_path}/logs", f"{tmp_path}/cp", n, trigger_seconds=None
            )
        }
    )
    got = {(r.message, r.service_name) for r in tables.read_logs(spark, f"{tmp_path}/logs").collect()}
    assert got == {("2024-01-15 10:30:45 - hello", "a"), ("no match", "a")}


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    schema = model.schema_of("message string, timestamp string, service_name string")
    times = [f"2024-01-01T00:0{m}:{s:02d}Z" for m in range(5) for s in (1, 30, 59)]
    rows = [("warn x", t, "api") for t in times] + [("end", "2024-01-01T01:00:00Z", "end")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    level = F.regexp_extract("message", r"^(\w+)", 1)
    counted = metrics.log_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), level, late_by="1 minute")
    query = (
        counted.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch_ = {tuple(r) for r in metrics.log_counts(spark.createDataFrame(rows, schema), level).where("service_name = 'api'").collect()}
    assert got == batch_ and len(got) == 5


def test_repeated_rows_are_dropped(spark, tmp_path):
    schema = model.schema_of("message string, timestamp string, service_name string")
    rows = [("a", "2024-01-01T00:00:00Z", "s")] * 3 + [("b", "2024-01-01T00:00:00Z", "s")]
    df = spark.createDataFrame(rows, schema)
    assert metrics.drop_repeats(df, "1 minute").count() == 2
    df.write.parquet(f"{tmp_path}/in")
    stream = metrics.drop_repeats(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 minute")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_batches_share_their_compiled_code(spark, tmp_path):
    """The time of ingest differs from batch to batch; as a number in the code it had each compiled anew."""
    for n in range(6):
        records(spark, ("s", str(n), T0 + n, 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
    counts = []

    def write(batch, number):
        batch.write.parquet(f"{tmp_path}/out/batch={number}")
        counts.append(compiled.getCount())

    rows = ingest.ingest_rows(ingest.read_record_files(spark, f"{tmp_path}/source", 1))
    stream = rows.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
    stream.foreachBatch(write).start().awaitTermination()
    assert len(counts) == 6 and counts[1] == counts[-1]
