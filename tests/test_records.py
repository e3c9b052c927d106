"""A log of record files: numbers that stay, batches of admitted sizes, starts at any place."""

import pytest
from pyspark.sql import functions as F

from tidelog.sources import records


class Log:
    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.folder, self.index = f"{root}/records", f"{root}/index"

    def add(self, *numbers):
        rows = self.spark.createDataFrame([(str(n).encode(), n * 10) for n in numbers], "value binary, seconds bigint")
        rows.coalesce(1).sortWithinPartitions("seconds").write.mode("append").parquet(self.folder)
        return self.extend()

    def extend(self):
        return records.extend_index(self.spark, self.folder, self.index, F.col("seconds"))

    def run(self, most=None, start=0, checkpoint="checkpoint", per_task=2):
        """Sizes of the batches of one run, and all values read so far on its checkpoint."""
        sizes = []

        def write(batch, number):
            sizes.append(batch.count())
            batch.write.mode("overwrite").parquet(f"{self.root}/{checkpoint}-out/batch={number}")

        source = records.read_record_log(self.spark, self.index, most, start, records_per_task=per_task)
        stream = source.writeStream.option("checkpointLocation", f"{self.root}/{checkpoint}").foreachBatch(write).start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        out = self.spark.read.schema("value binary, batch int").parquet(f"{self.root}/{checkpoint}-out")
        return [n for n in sizes if n], sorted(int(bytes(r.value)) for r in out.collect())


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def test_batches_hold_the_admitted_records(log):
    log.add(*range(5))
    log.add(*range(5, 12))
    assert log.run(4) == ([4, 4, 4], list(range(12)))
    assert log.run(5) == ([], list(range(12)))
    assert log.add(*range(12, 23)) == 23
    assert log.run(5) == ([5, 5, 1], list(range(23)))
    assert log.add(23) == 24
    assert log.run() == ([1], list(range(24)))


def test_numbers_stay_whatever_is_added(log):
    log.add(1, 2, 3)
    before = log.spark.read.parquet(log.index).collect()
    log.add(0)
    log.add(4, 5)
    rows = sorted(log.spark.read.schema(records.INDEX_SCHEMA).parquet(log.index).collect())
    assert before[0] in rows
    assert [(r.number, r.first, r.n_records, r.first_seconds, r.last_seconds) for r in rows] == [
        (0, 0, 3, 10, 30),
        (1, 3, 1, 0, 0),
        (2, 4, 2, 40, 50),
    ]
    assert log.extend() == 6 and log.extend() == 6


def test_start_at_an_offset_or_instant(log):
    log.add(1, 2, 3)
    log.add(6, 7, 8)
    at = {s: records.offset_at(log.spark, log.index, s, F.col("seconds")) for s in (0, 10, 11, 31, 65, 80, 81)}
    assert at == {0: 0, 10: 0, 11: 1, 31: 3, 65: 4, 80: 5, 81: 6}
    assert log.run(2, start=at[65], checkpoint="later") == ([2], [7, 8])
    assert log.run(2, start=at[81], checkpoint="end") == ([], [])
    log.add(9)
    assert log.run(2, start=at[81], checkpoint="end") == ([1], [9])


def test_no_files_and_bad_options(log):
    assert log.extend() == 0
    reader = records.RecordLogReader({"index": log.index})
    assert reader.latestOffset() == {"records": 0} and reader.partitions({"records": 0}, {"records": 0}) == []
    for option in ({"startingOffset": "-1"}, {"maxRecordsPerTrigger": "-1"}, {"recordsPerTask": "0"}):
        with pytest.raises(ValueError):
            records.RecordLogReader({"index": log.index, **option})


def test_parts_of_a_file_are_read_across_its_row_groups(log, spark):
    rows = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("value"), F.col("id").alias("seconds"))
    rows.coalesce(1).write.option("parquet.block.size", "1024").option("parquet.page.size.row.check.min", "10").option(
        "parquet.block.size.row.check.min", "10"
    ).parquet(log.folder)
    log.extend()
    reader = records.RecordLogReader({"index": log.index, "recordsPerTask": "7"})
    parts = reader.partitions({"records": 13}, {"records": 977})
    assert len(parts) == -(-(977 - 13) // 7)
    found = [int(v) for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert found == list(range(13, 977))


def test_a_restarted_reader_goes_on_behind_the_last_batch(log):
    log.add(*range(10))
    reader = records.RecordLogReader({"index": log.index, "maxRecordsPerTrigger": "3"})
    assert [reader.latestOffset()["records"] for _ in range(5)] == [3, 6, 9, 10, 10]
    again = records.RecordLogReader({"index": log.index, "maxRecordsPerTrigger": "3"})
    again.partitions({"records": 3}, {"records": 6})
    assert again.latestOffset() == {"records": 9}


def test_a_task_decodes_no_further_than_its_records(log, spark, monkeypatch):
    log.spark.range(100_000).select(F.col("id").cast("string").cast("binary").alias("value"), F.col("id").alias("seconds")).coalesce(
        1
    ).write.parquet(log.folder)
    log.extend()
    decoded, given = [], records.pq.ParquetFile.iter_batches

    def counted(*args, **kwargs):
        for batch in given(*args, **kwargs):
            decoded.append(batch.num_rows)
            yield batch

    monkeypatch.setattr(records.pq.ParquetFile, "iter_batches", counted)
    reader = records.RecordLogReader({"index": log.index})
    (part,) = reader.partitions({"records": 100}, {"records": 110})
    found = [int(v) for b in reader.read(part) for v in b.column("value").to_pylist()]
    assert found == list(range(100, 110)) and sum(decoded) <= records.BATCH_RECORDS


def test_streams_that_share_a_log_read_all_of_it_once(log):
    assert records.shares(0, 23, 4, 3) == [(0, 8), (8, 16), (16, 23)]
    assert records.shares(5, 8, 4, 3) == [(5, 8)] and records.shares(8, 8, 4, 3) == []
    log.add(*range(23))
    read = []
    for first, last in records.shares(3, 23, 4, 2):
        reader = records.RecordLogReader(
            {"index": log.index, "startingOffset": str(first), "endingOffset": str(last), "maxRecordsPerTrigger": "4"}
        )
        begin = reader.initialOffset()
        while (end := reader.latestOffset()) != begin:
            parts = reader.partitions(begin, end)
            read.append([int(v) for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()])
            begin = end
    assert read == [list(range(a, a + 4)) for a in range(3, 23, 4)]
    with pytest.raises(ValueError):
        records.RecordLogReader({"index": log.index, "startingOffset": "2", "endingOffset": "1"})


def test_the_index_is_read_again_only_for_records_behind_it(log, monkeypatch):
    log.add(*range(10))
    reads, given = [], records.pq.read_table
    monkeypatch.setattr(records.pq, "read_table", lambda *args, **kwargs: reads.append(1) or given(*args, **kwargs))
    reader = records.RecordLogReader({"index": log.index, "maxRecordsPerTrigger": "2", "endingOffset": "12"})

    def batches(n):
        begin = reader.initialOffset()["records"] if reader.at is None else reader.at
        for _ in range(n):
            parts = reader.partitions({"records": begin}, reader.latestOffset())
            yield [int(v) for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
            begin = reader.at

    assert list(batches(5)) == [[a, a + 1] for a in range(0, 10, 2)] and len(reads) == 1
    assert list(batches(1)) == [[]] and len(reads) == 2
    log.add(*range(10, 20))
    assert list(batches(2)) == [[10, 11], []] and len(reads) == 3
