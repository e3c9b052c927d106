import glob
import os
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import timefmt
from tidelog.operators import predicates, shaping
from tidelog.plans.search import (
    MinuteWindows,
    SearchParams,
    filter_logs,
    search,
    search_in_windows,
    search_table,
    top_rows,
)
from tidelog.sinks import logs as sink
from tidelog.sources import tiers

ROWS = [
    (1, "Error: disk full", "2024-01-01T10:05:00Z", "api", "host-1"),
    (2, "warn a.b", "2024-01-01T10:05:00.500Z", "api", "host-2"),
    (3, "info axb", "2024-01-01T10:05:59.999999999Z", "api", None),
    (4, None, "2024-01-01T10:06:00Z", "api", "host-1"),
    (5, '{"user": "u1", "n": 5}', "2024-01-01T10:07:30Z", "web", "host-3"),
    (6, "late error", "2024-01-01T10:08:00Z", "api", "host-1"),
]
BASE = SearchParams(["api", "web"], datetime(2024, 1, 1, 10, 5, 30), datetime(2024, 1, 1, 10, 7, 1))


@pytest.fixture(scope="module")
def logs(spark):
    df = spark.createDataFrame(
        ROWS, "id int, message string, timestamp string, service_name string, hostname string"
    )
    return df.withColumn("time", timefmt.partition_time(timefmt.epoch_seconds(F.col("timestamp"))))


def ids(rows):
    return sorted(r.id for r in rows.collect())


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, [1, 2, 3, 4, 5]),
        ({"exact_times": True}, [3, 4]),
        ({"services": ["web"]}, [5]),
        ({"text_search": "Error,warn"}, [1, 2]),
        ({"text_search": "error"}, []),
        ({"text_search": "a.b"}, [2, 3]),
        ({"text_search": "a.b", "literal_terms": True}, [2]),
        ({"text_search": "zzz,"}, [1, 2, 3, 5]),
        ({"exclude_text": "Error,warn"}, [3, 5]),
        ({"exclude_text": "zzz"}, [1, 2, 3, 5]),
        ({"regex_search": "^[a-z]+ a"}, [2, 3]),
        ({"hosts": "host-1,host-3"}, [1, 4, 5]),
        ({"hosts": "none"}, []),
    ],
)
def test_predicates(logs, change, expected):
    assert ids(filter_logs(logs, replace(BASE, **change))) == expected


def test_switched_off_predicates_leave_no_trace(logs):
    plan = filter_logs(logs, BASE)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "hostname#" not in plan.split("Filter")[1].split("\n")[0]


def test_rows_are_ordered_by_time_not_text(logs):
    rows = logs.where("id <= 3")
    assert [r.id for r in top_rows(rows, "asc", 10).collect()] == [1, 2, 3]
    assert [r.id for r in top_rows(rows, "desc", 2).collect()] == [3, 2]
    assert [r.id for r in top_rows(rows, "asc", 10, "text").collect()] == [2, 1, 3]


def test_top_rows_need_no_full_sort(logs):
    plan = top_rows(logs)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_columns_are_checked(logs):
    assert search(logs, BASE).columns == ["message"]
    assert search(logs, replace(BASE, columns=["hostname", "timestamp"])).columns == ["hostname", "timestamp"]
    with pytest.raises(ValueError, match="column"):
        search(logs, replace(BASE, columns=["id"]))
    with pytest.raises(ValueError, match="services"):
        search(logs, replace(BASE, services=[]))
    with pytest.raises(ValueError, match="sort"):
        search(logs, replace(BASE, sort="up"))


def test_json_fields_become_columns(logs):
    p = replace(BASE, services=["web"], json_fields=True)
    row = search(logs, p).first()
    assert row.asDict() == {"message": ROWS[4][1], "n": "5", "user": "u1"}
    assert search(logs, replace(p, include=["user"])).columns == ["user"]


def test_any_number_of_json_keys(spark, logs):
    df = spark.createDataFrame([(f'{{"k{i}": 1, "message": 2}}',) for i in range(300)], "message string")
    assert {len(r.fields) for r in shaping.extract_json_fields(df).collect()} == {2}
    many = logs.where("service_name = 'web'").limit(1).crossJoin(spark.range(300).withColumnRenamed("id", "i"))
    many = many.withColumn("message", F.concat(F.lit('{"k'), "i", F.lit('": 1}'))).drop("i")
    found = search(many, replace(BASE, services=["web"], json_fields=True, limit=300))
    assert len(found.columns) == 301 and found.count() == 300


def test_json_keys_of_any_spelling(spark):
    df = spark.createDataFrame([('{"http.status": 200, "Message": "m", "User": "u"}',), ('{"user": "v"}',)], "message string")
    keys = shaping.json_keys(df)
    rows = shaping.extract_json_fields(df, keys=keys)
    assert rows.columns == ["message", "User", "http.status"]
    assert [r["User"] for r in rows.collect()] == ["u", "v"]
    chosen = shaping.include_fields(rows, ["http.status", "user", "absent"])
    assert chosen.columns == ["User", "http.status"] and chosen.collect()[0]["http.status"] == "200"


def test_stored_table_is_searched_both_ways(spark, tmp_path):
    root = str(tmp_path / "logs")
    df = spark.createDataFrame([(r[1], r[2], r[3]) for r in ROWS], model.INGEST_SCHEMA)
    sink.write_logs(sink.with_time_partitions(df), root)
    p = replace(BASE, columns=["timestamp", "service_name", "message"])
    plain, projected = (search_table(spark, root, p, projected=x).collect() for x in (False, True))
    assert plain == projected and [r.timestamp for r in plain] == [ROWS[i][2] for i in (4, 3, 2, 1, 0)]
    # Rows of this table have no host, so a search by host finds none.
    assert search_table(spark, root, replace(p, hosts="host-1")).count() == 0


def test_listed_values(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, host string")
    lists = spark.createDataFrame([("a,c",), ("c,c,d",)], "hosts string")
    assert ids(predicates.of_listed(rows, "host", lists, "hosts")) == [1, 3]


def test_message_must_be_text(spark):
    bodies = ['{"message": "m"}', '{"message": 5}', '{"message": {"a": 1}}', '{"message": null}', "{}", "no json"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    assert ids(shaping.normalise_message(df)) == [0]
    flagged = shaping.normalise_message(df, on_invalid="quarantine").collect()
    assert [r.invalid for r in sorted(flagged, key=lambda r: r.id)] == [False] + [True] * 5
    passed = {r.id: r.message for r in shaping.normalise_message(df, on_invalid="pass").collect()}
    assert passed[0] == "m" and passed[1] == "5" and passed[3] is None
    as_variant = df.withColumn("body", F.try_parse_json("body"))
    assert ids(shaping.normalise_message(as_variant)) == [0]


def test_resources_and_attributes(spark):
    df = spark.createDataFrame(
        [(1, "own", {"service_name": "res"}), (2, "own", {"x": "y"}), (3, "own", None)],
        "id int, service_name string, resources map<string,string>",
    )
    got = [r.service_name for r in shaping.enrich_service(df).orderBy("id").collect()]
    assert got == ["res", "own", "own"]
    set_ = shaping.upsert_attribute(df, "service_name", "new", attributes="resources")
    assert [r.resources["service_name"] for r in set_.collect()] == ["new"] * 3


def test_named_groups_may_replace_columns(spark):
    df = spark.createDataFrame([("2024 - m",), ("x",)], "message string")
    rows = shaping.parse_named_groups(df, r"^(?P<year>\d{4}) - (?P<message>.*)$", text="message").collect()
    assert [(r.year, r.message, r.matched) for r in rows] == [("2024", "m", True), (None, None, False)]


def minute_rows(n):
    return [
        (f"m{i}", f"2024-01-01T{10 + i // 60:02d}:{i % 60:02d}:{i * 7 % 60:02d}Z", "api" if i % 3 else "web", f"host-{i % 4}")
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def hourly(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("hourly") / "table")
    rows = spark.createDataFrame(minute_rows(180), "message string, timestamp string, service_name string, hostname string")
    sink.write_logs(sink.with_time_partitions(rows), root)
    return root


RANGE = SearchParams(["api", "web"], datetime(2024, 1, 1, 9, 0), datetime(2024, 1, 1, 13, 30), limit=10)


@pytest.mark.parametrize(
    "change",
    [
        {},
        {"sort": "asc"},
        {"limit": 1},
        {"limit": 100},
        {"limit": 1000},
        {"limit": 0},
        {"services": ["web"], "hosts": "host-1"},
        {"text_search": "m17"},
        {"text_search": "no such text"},
        {"services": ["none"]},
        {"exact_times": True, "end": datetime(2024, 1, 1, 10, 30, 20)},
        {"end": datetime(2024, 1, 1, 8, 0)},
    ],
)
def test_windows_find_what_a_whole_sort_finds(spark, hourly, change):
    p = replace(RANGE, columns=("message", "timestamp"), **change)
    by_windows = [tuple(r) for r in search_table(spark, hourly, p).collect()]
    assert by_windows == [tuple(r) for r in search_table(spark, hourly, p, progressive=False).collect()]


def test_windows_cover_the_range_once():
    for newest in (True, False):
        ahead = MinuteWindows(datetime(2024, 1, 1, 10, 5, 30), datetime(2024, 1, 1, 11, 7, 1), newest, 2)
        windows = list(iter(ahead.next, None))
        minutes = [a + timedelta(minutes=i) for a, b in windows for i in range(int((b - a).total_seconds()) // 60 + 1)]
        assert sorted(minutes) == [datetime(2024, 1, 1, 10, 5) + timedelta(minutes=i) for i in range(63)]
        assert [int((b - a).total_seconds()) // 60 + 1 for a, b in windows] == [2, 4, 8, 16, 32, 1]
        assert (windows == sorted(windows, reverse=newest))


def test_only_the_newest_files_are_read(spark, tmp_path):
    """Files of older minutes are broken, so that whoever reads them fails."""
    root = str(tmp_path / "table")
    rows = spark.createDataFrame(minute_rows(60), "message string, timestamp string, service_name string, hostname string")
    sink.write_logs(sink.with_time_partitions(rows), root)
    for file in glob.glob(f"{root}/service_name=*/year=2024/month=01/day=01/hour=10/minute=[0-3]?/*.parquet"):
        os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
        with open(file, "wb") as broken:
            broken.write(b"no parquet")
    p = replace(RANGE, columns=("message",))
    assert [r.message for r in search_table(spark, root, p).collect()] == [f"m{i}" for i in range(59, 49, -1)]
    with pytest.raises(Exception, match="(?i)parquet"):
        search_table(spark, root, p, progressive=False).collect()
    source = tiers.Tiered(spark, root)
    found = search_in_windows(spark, lambda a, b: source.read(p.services, a, b), p)
    assert [int((b - a).total_seconds()) // 60 + 1 for a, b in found.windows] == [1, 2, 4, 8]


def test_json_fields_of_a_windowed_search(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = [('{"user": "u%d"}' % i, f"2024-01-01T10:{i:02d}:00Z", "api", None) for i in range(20)]
    df = spark.createDataFrame(rows, "message string, timestamp string, service_name string, hostname string")
    sink.write_logs(sink.with_time_partitions(df), root)
    found = search_table(spark, root, replace(RANGE, services=["api"], json_fields=True, limit=3))
    assert [r.user for r in found.collect()] == ["u19", "u18", "u17"]
