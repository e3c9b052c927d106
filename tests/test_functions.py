import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.functions import keys, patterns, sizing, timefmt
from tidelog.operators import history, maintenance


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_iso_text_has_as_few_digits_as_keep_the_instant(spark):
    rows = [
        (1609459200, 0),
        (1609459200, 500_000_000),
        (1609459200, 123_456_000),
        (1609459200, 123_456_789),
        (0, 1),
        (-1, 0),
        (-62135596800, 0),
    ]
    iso = timefmt.iso_instant(F.col("s"), F.col("n"))
    assert [v for (v,) in values(spark, rows, "s bigint, n int", iso)] == [
        "2021-01-01T00:00:00Z",
        "2021-01-01T00:00:00.500Z",
        "2021-01-01T00:00:00.123456Z",
        "2021-01-01T00:00:00.123456789Z",
        "1970-01-01T00:00:00.000000001Z",
        "1969-12-31T23:59:59Z",
        "0001-01-01T00:00:00Z",
    ]


def test_iso_text_and_partitions_of_any_instant(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(-62135596800, 253402300800), rng.choice([0, 5, 10**9 - 1])) for _ in range(2000)]
    seconds = F.col("s")
    iso = timefmt.iso_instant(seconds, F.col("n"))
    got = values(spark, rows, "s bigint, n int", "s", "n", iso, timefmt.partition_time(seconds), timefmt.epoch_seconds(iso))
    for s, n, text, time, again in got:
        at = datetime(1970, 1, 1) + timedelta(seconds=s)
        fraction = f".{n:09d}" if n else ""
        day = f"{at.year:04d}-{at:%m-%d}T{at:%H:%M:%S}"
        assert text == f"{day}{fraction}Z" and again == s
        assert time == f"year={at.year:04d}/" + at.strftime("month=%m/day=%d/hour=%H/minute=%M")


def test_sql_timestamp_cuts_at_microseconds(spark):
    rows = [(1609459200, 0), (1609459200, 500_000_000), (1609459200, 1_999)]
    at = timefmt.sql_timestamp(F.col("s"), F.col("n"))
    assert values(spark, rows, "s bigint, n int", F.unix_micros(at)) == [
        (1609459200000000,),
        (1609459200500000,),
        (1609459200000001,),
    ]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_partitions_do_not_depend_on_the_session_time_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        seconds = timefmt.epoch_seconds(F.col("t"))
        parts = timefmt.time_partitions(seconds)
        rows = [("2024-01-01T23:30:00Z",), ("2024-03-10T02:30:00.5Z",), ("",)]
        got = values(
            spark, rows, "t string", timefmt.partition_time(seconds), *parts.values(),
            timefmt.iso_instant(seconds, F.lit(0)),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == (
        "year=2024/month=01/day=01/hour=23/minute=30", 2024, "01", "01", "23", "30", "2024-01-01T23:30:00Z",
    )
    assert got[1][0] == "year=2024/month=03/day=10/hour=02/minute=30"
    assert got[2][1:] == (None,) * 6


def test_instant_order_sorts_all_fraction_widths(spark):
    texts = [
        "2024-01-01T00:00:00Z",
        "2024-01-01T00:00:00.000000001Z",
        "2024-01-01T00:00:00.123456Z",
        "2024-01-01T00:00:00.123456789Z",
        "2024-01-01T00:00:00.500Z",
        "2024-01-01T00:00:01Z",
    ]
    df = spark.createDataFrame([(t,) for t in reversed(texts)], "t string")
    ordered = [r.t for r in df.orderBy(timefmt.instant_order(F.col("t"))).collect()]
    assert ordered == texts


def test_comma_alternatives():
    assert patterns.comma_alternatives("a,b.c") == "a|b.c"
    assert patterns.comma_alternatives("a,") == "a|"
    assert patterns.comma_alternatives("a.b,c", literal=True) == r"\Qa.b\E|\Qc\E"


def test_literal_terms_match_only_themselves(spark):
    rows = [("a.b",), ("axb",), (r"x\Ey",)]
    pattern = patterns.comma_alternatives(r"a.b,\Ey", literal=True)
    assert values(spark, rows, "m string", F.col("m").rlike(pattern)) == [(True,), (False,), (True,)]


def test_named_groups(spark):
    pattern = r"(?P<who>\w+)@(?P<where>[a-z.]+)(?: #(?P<tag>\d+))?"
    groups = patterns.extract_groups(F.col("v"), pattern)
    rows = [("to ann@host.a #7, bob@b",), ("x\nann@b c",), ("ann@b\x01#",), ("nobody",), (None,)]
    got = values(spark, rows, "v string", groups["who"], groups["where"], groups["tag"])
    assert got == [("ann", "host.a", "7"), ("ann", "b", ""), ("ann", "b", ""), (None,) * 3, (None,) * 3]


def test_keys(spark):
    rows = [
        ("a/service_name=x/b/service_name=y/part",),
        ("service_name=billing/",),
        ("t/service_name=cart/year=2023/month=12/day=31/hour=04/minute=09/p.parquet",),
        ("t/service=cart/part",),
        ("service_name=api%3Av2%2F50%25 a+b/year=x",),
    ]
    path = F.col("p")
    hour, minute = keys.clock_from_key(path)
    got = values(spark, rows, "p string", keys.service_from_key(path), keys.minute_from_key(path), hour, minute)
    at = int((datetime(2023, 12, 31, 4, 9) - datetime(1970, 1, 1)) / timedelta(seconds=1))
    assert got == [
        ("x", None, None, None),
        ("billing", None, None, None),
        ("cart", at, 4, 9),
        (None, None, None, None),
        ("api:v2/50% a+b", None, None, None),
    ]


def test_partition_names_are_escaped_as_spark_does(spark, tmp_path):
    names = ["a:b", "c/d", "50%", "x=y", "p+q r", "é{1}", "plain", 'q"\\?*[t]^']
    df = spark.createDataFrame([(n,) for n in names], "s string")
    df.withColumn("v", F.lit(1)).write.partitionBy("s").parquet(f"{tmp_path}/t")
    folders = {f.name.removeprefix("s=") for f in (tmp_path / "t").iterdir() if f.name.startswith("s=")}
    escaped = df.select(keys.escape(F.col("s")).alias("e"), "s")
    assert {r.e for r in escaped.collect()} == folders
    assert [r[0] == r[1] for r in escaped.select(keys.unescape(F.col("e")), "s").collect()] == [True] * len(names)


def test_nanoseconds_are_carried_and_far_times_refused(spark):
    rows = [(1, 1_500_000_000), (1, -500_000_000), (253402300799, 10**9), (1609459200000000, 0), (-62135596801, 5)]
    iso = timefmt.iso_instant(F.col("s"), F.col("n"))
    ok = timefmt.is_storable(F.col("s"), F.col("n"))
    assert values(spark, rows, "s bigint, n bigint", iso, ok) == [
        ("1970-01-01T00:00:02.500Z", True),
        ("1970-01-01T00:00:00.500Z", True),
        (None, False),
        (None, False),
        (None, False),
    ]


def test_padding_never_cuts(spark):
    assert values(spark, [(7,), (123,)], "v int", timefmt.zero_pad(F.col("v"))) == [("07",), ("123",)]


def test_common_prefix(spark):
    rows = [("logs/a/b",), ("logs/c",), ("other/a/b",)]
    assert values(spark, rows, "p string", keys.common_prefix(F.col("p"), "logs/")) == [
        ("logs/a/",), (None,), (None,),
    ]


def test_sink_log_names(spark):
    rows = [("0",), ("409.compact",), ("x9",), ("",), ("9.crc",)]
    valid = keys.is_sink_log_name(F.col("n"))
    assert [v for (v,) in values(spark, rows, "n string", valid)] == [True, True, False, False, False]


@pytest.mark.parametrize(
    "names, latest", [(["2", "111", "20"], ("111", 111, False)), (["39", "40", "40.compact"], ("40.compact", 40, True))]
)
def test_latest_sink_log(spark, names, latest):
    rows = [(f"t/_spark_metadata/{n}",) for n in [*names, "tmp.compact"]]
    files = maintenance.sink_log_files(spark.createDataFrame(rows, "path string"))
    assert tuple(maintenance.latest_sink_log(files).first()) == latest


def test_map_to_json(spark):
    rows = [({"a": "b"},), ({},), (None,)]
    got = values(spark, rows, "m map<string,string>", patterns.map_to_json(F.col("m")))
    assert [v for (v,) in got] == ['{"a":"b"}', "{}", "{}"]


def test_admission_size(spark):
    rows = [(None,), (10,), (1000,), (10_000,)]
    expected = [750_000_000, 500_000_000, 1_100_000_000, 3_500_000_000]
    got = values(spark, rows, "c int", sizing.admission_size(F.col("c")))
    assert [v for (v,) in got] == expected
    assert [sizing.admission_records(c) for (c,) in rows] == expected


def test_workers_from_cores(spark):
    got = values(spark, [(8,), (9,), (0,), (None,)], "c int", sizing.workers_from_cores(F.col("c"), 4))
    assert [v for (v,) in got] == [2, 3, None, None]


@pytest.mark.parametrize(
    "actual, expected, up, down, outcome",
    [
        (10, 1, True, True, ("down", 7)),
        (100, 90, True, True, ("down", 90)),
        (10, 9, True, True, ("none", 10)),
        (10, 1, True, False, ("none", 10)),
        (4, 8, True, True, ("up", 8)),
        (4, 5, True, True, ("up", 5)),
        (4, 8, False, True, ("none", 4)),
        (4, 4, True, True, ("none", 4)),
        (4, None, True, True, ("none", 4)),
        (4, 0, True, True, ("none", 4)),
        (0, 4, True, True, ("none", 0)),
        (1000, 2, True, True, ("down", 950)),
    ],
)
def test_scale_decision(spark, actual, expected, up, down, outcome):
    row = spark.createDataFrame([(actual, expected, up, down)], "a int, e int, u boolean, d boolean")
    largest = 10 if actual <= 10 else 1000
    decided = row.select(
        sizing.scale_decision(F.col("a"), F.col("e"), F.col("u"), F.col("d"), 2, largest).alias("x")
    ).first().x
    assert (decided.action, decided.target) == outcome


def test_upscale_step_is_bounded(spark):
    decided = spark.range(1).select(
        sizing.scale_decision(F.lit(10), F.lit(900), F.lit(True), F.lit(True), 2, 1000).alias("x")
    ).first().x
    assert (decided.action, decided.target) == ("up", 210)


def test_compaction_buffer(spark):
    rows = [(n,) for n in (0, 6, 7, 8, 9, 17)]
    got = values(
        spark, rows, "n bigint", sizing.compaction_buffer(F.col("n")), sizing.allows_downscale(F.col("n"))
    )
    assert got == [(0.0, True), (0.0, True), (0.5, True), (0.5, False), (0.5, True), (0.5, True)]


@pytest.mark.parametrize(
    "series, growth, rising, largest",
    [
        ([300, 200, 100], 0.75, True, True),
        ([100, 200, 300], -0.416667, False, False),
        ([100], 0, True, True),
        ([1000] * 5, 0, True, True),
        ([5, 4, 0, 0, 0], 0.25, True, True),
    ],
)
def test_series_facts(spark, series, growth, rising, largest):
    x = F.col("x")
    row = spark.createDataFrame([(series,)], "x array<bigint>").select(
        history.series_growth(x), history.is_rising(x), history.newest_is_largest(x)
    )
    got = row.first()
    assert got[0] == pytest.approx(growth, abs=1e-6)
    assert (got[1], got[2]) == (rising, largest)
