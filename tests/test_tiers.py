"""A stream's table in two tiers: only committed rows, each once, whenever they come."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.plans.search import SearchParams, search_table
from tidelog.sinks import logs as sink
from tidelog.sinks import versioned
from tidelog.sources import tiers
from tidelog.streaming import ingest

SCHEMA = "message string, timestamp string, service_name string, hostname string"
SERVICES = ["api", "a b/c=%2}", "Ünï"]
START, END = datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 3, 23, 59)


class Stream:
    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0
        self.table, self.closed = f"{root}/table", f"{root}/closed"

    def add(self, *minutes):
        rows = [(f"{s} {m} {self.n}", f"2024-01-{m}:30Z", s, "h") for m in minutes for s in SERVICES]
        self.n += 1
        columns = sink.with_time_partitions(self.spark.createDataFrame(rows, SCHEMA))
        columns.write.mode("append").parquet(f"{self.root}/source")
        stream = self.spark.readStream.schema(columns.schema).parquet(f"{self.root}/source")
        ingest.start_sink(stream, self.table, f"{self.root}/checkpoint", trigger_seconds=None).awaitTermination()
        return [r[0] for r in rows]

    def lose(self, minute):
        """Leaves a file in the table that no batch has committed."""
        rows = sink.with_time_partitions(self.spark.createDataFrame([("lost", f"2024-01-{minute}:30Z", "api", "h")], SCHEMA))
        rows.write.mode("append").partitionBy(*model.PARTITION_COLUMNS).parquet(self.table)

    def found(self, start=START, end=END, closed=True, services=SERVICES):
        source = tiers.Tiered(self.spark, self.table, self.closed if closed else None)
        return sorted(r.message for r in source.read_all(services, start, end).collect())


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, str(tmp_path))


def test_only_committed_files_of_the_range(spark, stream):
    first = stream.add("01T10:05", "01T10:06")
    stream.lose("01T10:05")
    assert stream.found(closed=False) == sorted(first)
    assert stream.found(datetime(2024, 1, 1, 10, 6), END, closed=False) == sorted(m for m in first if "10:06" in m)
    assert stream.found(closed=False, services=["Ünï"]) == sorted(m for m in first if m.startswith("Ünï"))
    assert stream.found(datetime(2024, 1, 2), END, closed=False) == []
    p = SearchParams(["api"], START, END)
    for progressive in (True, False):
        messages = [r.message for r in search_table(spark, stream.table, p, progressive=progressive).collect()]
        assert messages == ["api 01T10:06 0", "api 01T10:05 0"]


def test_each_row_comes_from_one_tier(spark, stream):
    first = stream.add("01T10:05", "02T10:05", "02T23:59")
    stream.lose("01T10:05")
    assert tiers.close_until(spark, stream.table, stream.closed, datetime(2024, 1, 2)) is not None
    assert stream.found() == sorted(first)
    # Late rows of a closed minute, and of the open day.
    late = stream.add("01T10:05", "02T10:07")
    assert stream.found() == sorted(first + late)
    assert stream.found(START, datetime(2024, 1, 1, 23, 59)) == sorted(m for m in first + late if " 01T" in m)
    assert tiers.close_until(spark, stream.table, stream.closed, datetime(2024, 1, 3)) is not None
    assert stream.found() == sorted(first + late)
    assert tiers.close_until(spark, stream.table, stream.closed, datetime(2024, 1, 3)) is None
    later = stream.add("03T00:00")
    assert stream.found() == sorted(first + late + later)


def test_a_lost_rollover_changes_nothing(spark, stream, monkeypatch):
    rows = stream.add("01T10:05", "01T10:06")

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versioned, "replace_table", fail)
        with pytest.raises(RuntimeError):
            tiers.close_until(spark, stream.table, stream.closed, datetime(2024, 1, 2))
    assert stream.found() == sorted(rows)
    tiers.close_until(spark, stream.table, stream.closed, datetime(2024, 1, 2))
    assert stream.found() == sorted(rows)


def test_the_log_is_read_across_compactions(spark, stream):
    spark.conf.set("spark.sql.streaming.fileSink.log.compactInterval", "2")
    try:
        rows = [m for n in range(5) for m in stream.add(f"01T10:0{n}")]
    finally:
        spark.conf.unset("spark.sql.streaming.fileSink.log.compactInterval")
    names = [path.rsplit("/", 1)[-1] for path in tiers._log_files(spark, stream.table)]
    assert names == ["3.compact", "4"]
    assert stream.found(closed=False) == sorted(rows)


def test_batch_tables_and_empty_ones(spark, tmp_path):
    root = str(tmp_path / "table")
    assert tiers.Tiered(spark, root).read(["api"], START, END) is None
    assert tiers.close_until(spark, root, str(tmp_path / "closed"), END) is None
    rows = spark.createDataFrame([("x", "2024-01-01T10:05:00Z", "api", "h")], SCHEMA)
    sink.write_logs(sink.with_time_partitions(rows), root)
    source = tiers.Tiered(spark, root)
    assert not source.streamed and source.read_all(["api"], START, END).count() == 1
    assert source.read_all(["web"], START, END).agg(F.count("time")).first()[0] == 0
