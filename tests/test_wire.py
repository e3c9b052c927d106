import base64

import pytest
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
from pyspark.sql import functions as F

from tidelog import model
from tidelog.sources import wire


@pytest.fixture(scope="module")
def record_type():
    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(wire.descriptor_set()).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("tidelog.wire.LogRecord"))


def record(record_type, service="", message="", level="", seconds=None, nanos=0):
    r = record_type(service_name=service, message=message, log_level=level)
    if seconds is not None:
        r.timestamp.seconds, r.timestamp.nanos = seconds, nanos
    return r.SerializeToString()


CASES = [
    dict(service="api-service", message="Test log message", level="info", seconds=1609459200, nanos=500_000_000),
    dict(message="Minimal log"),
    dict(),
    dict(service="dienst-ü", message="日本語 \n\t \"quoted\" 🚀", seconds=1),
    dict(service="s", message="x" * 20_000, seconds=253402300799, nanos=999_999_999),
    dict(service="s", message="before the epoch", seconds=-1, nanos=1),
]


def test_decoding_gives_back_what_was_encoded(spark, record_type):
    rows = [(i, record(record_type, **c)) for i, c in enumerate(CASES)]
    df = wire.decode_records(spark.createDataFrame(rows, "id int, value binary"))
    for row in df.collect():
        c = CASES[row.id]
        assert not row.corrupt
        assert (row.service_name, row.message, row.log_level) == (
            c.get("service", ""), c.get("message", ""), c.get("level", ""),
        )
        assert (row.seconds, row.nanos) == (c.get("seconds", 0), c.get("nanos", 0))


def test_encoding_on_the_jvm_equals_the_runtime(spark, record_type):
    rows = [
        (i, c.get("service"), c.get("message"), c.get("level"), c.get("seconds"), c.get("nanos", 0))
        for i, c in enumerate(CASES)
    ]
    df = spark.createDataFrame(rows, "id int, s string, m string, l string, t bigint, n int")
    nanos = F.when(F.col("t").isNotNull(), F.col("n"))
    encoded = wire.encode_records(df, F.col("s"), F.col("m"), F.col("l"), F.col("t"), nanos)
    assert encoded.columns == [*df.columns, "value"]
    for row in encoded.collect():
        assert bytes(row.value) == record(record_type, **CASES[row.id])


def log_row(spark, value, **kwargs):
    df = spark.createDataFrame([(value,)], "value binary")
    return wire.log_rows(wire.decode_records(df), **kwargs).first()


def test_absent_fields_are_empty_text_and_the_epoch(spark, record_type):
    row = log_row(spark, record(record_type, message="Minimal log"))
    assert tuple(row) == ("Minimal log", "1970-01-01T00:00:00Z", "")


def test_level_is_kept_on_demand(spark, record_type):
    row = log_row(spark, record(record_type, level="warn", seconds=1), keep_log_level=True)
    assert row.log_level == "warn"


@pytest.mark.parametrize("value", [bytes([0, 1, 2, 3, 4, 5]), None])
def test_corrupt_bytes_are_kept(spark, value):
    row = log_row(spark, value)
    kept = base64.b64encode(value).decode() if value else ""
    assert (row.service_name, row.message) == (model.DEAD_LETTER_SERVICE, kept)


def test_corrupt_bytes_can_fail_the_query(spark):
    with pytest.raises(Exception, match="corrupt log record"):
        log_row(spark, bytes([0, 1, 2, 3, 4, 5]), on_corrupt="fail")


def test_missing_time_can_be_the_time_of_ingest(spark, record_type):
    row = log_row(spark, record(record_type, service="s"), on_missing_ts="ingest_time")
    assert row.timestamp > "2020" and row.service_name == "s"
    row = log_row(spark, record(record_type, service="s", message="m"), on_missing_ts="dead_letter")
    assert row.service_name == model.DEAD_LETTER_SERVICE and row.timestamp > "2020"
    assert base64.b64decode(row.message) == record(record_type, service="s", message="m")


@pytest.mark.parametrize("seconds", [1609459200000000, -(2**62), 2**63 - 1, 253402300800])
def test_a_time_out_of_range_makes_a_dead_letter(spark, record_type, seconds):
    value = encoded_with_seconds(spark, seconds)
    row = log_row(spark, value)
    assert row.service_name == model.DEAD_LETTER_SERVICE and row.timestamp > "2020"
    assert base64.b64decode(row.message) == value


def encoded_with_seconds(spark, seconds):
    df = spark.createDataFrame([("s", "m" * 100, seconds)], "s string, m string, t bigint")
    records = wire.encode_records(df, F.col("s"), F.col("m"), None, F.col("t"), F.lit(0))
    return bytes(records.first().value)


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError, match="on_corrupt"):
        log_row(spark, b"", on_corrupt="ignore")


def test_the_plan_of_log_rows_stays_short(spark):
    """Steps that are used more than once are not written out again at each use."""
    records = spark.createDataFrame([(b"",)], "value binary")
    for missing in ("epoch", "ingest_time", "dead_letter"):
        rows = wire.log_rows(wire.decode_records(records, native=False), on_missing_ts=missing, time_partitions=True)
        assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 6000
