import fnmatch
import gzip
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import model
from tidelog.sinks import logs as sink
from tidelog.sinks import versioned
from tidelog.sources import files, kafka, listing, tables

SERVICES = ["api", "007", "", "a,b", "x}y", "a=b/c", "sp ace"]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("logs") / "table")
    rows = [
        (f"m{i}", f"2024-01-0{1 + i % 2}T{23 if i % 2 == 0 else 0:02d}:5{i % 3}:00.{i:03d}Z", service)
        for i, service in enumerate(SERVICES * 6)
    ]
    df = spark.createDataFrame(rows, model.INGEST_SCHEMA)
    sink.write_logs(sink.with_time_partitions(df), folder)
    return folder


def test_partition_values_are_read_back_as_written(spark, root):
    logs = tables.read_logs(spark, root)
    assert {r.service_name for r in logs.collect()} == {s or None for s in SERVICES}
    assert {(r.month, r.hour) for r in logs.collect()} == {("01", "23"), ("01", "00")}
    assert {r.hostname for r in logs.collect()} == {None}
    assert dict(logs.dtypes)["year"] == "string"


def test_empty_service_can_be_named(spark):
    df = spark.createDataFrame([("m", "t", ""), ("m", "t", None), ("m", "t", "s")], model.INGEST_SCHEMA)
    assert [r.service_name for r in sink.name_empty_services(df).collect()] == ["unknown", "unknown", "s"]


def test_projected_scan_equals_the_filtered_table(spark, root):
    start, end = datetime(2024, 1, 1, 23, 51), datetime(2024, 1, 2, 0, 51, 30)
    wanted = ["api", "", "a,b", "x}y", "a=b/c", "absent"]
    projected = tables.read_logs_projected(spark, root, wanted, start, end)
    service = F.coalesce("service_name", F.lit(""))
    full = tables.read_logs(spark, root).where(
        F.col("time").between(
            "year=2024/month=01/day=01/hour=23/minute=51", "year=2024/month=01/day=02/hour=00/minute=51"
        )
        & service.isin(wanted)
    )
    assert projected.count() == full.count() > 0
    assert projected.exceptAll(full).count() == 0


def test_projected_scan_of_nothing_is_empty(spark, root):
    rows = tables.read_logs_projected(spark, root, ["absent"], datetime(2020, 1, 1), datetime(2020, 1, 2))
    assert rows.count() == 0 and "time" in rows.columns
    with pytest.raises(ValueError, match="services"):
        tables.read_logs_projected(spark, root, [], datetime(2020, 1, 1), datetime(2020, 1, 2))


def test_predicates_on_time_and_service_prune_partitions(spark, root):
    rows = tables.read_logs(spark, root).where(
        F.col("time").between("year=2024/month=01/day=01", "year=2024/month=01/day=02")
        & F.col("service_name").isin("api")
    )
    plan = rows.select("message")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service_name" in plan and "concat_ws(/" in plan
    assert "DataFilters: []" in plan and "Filter " not in plan.split("FileScan")[0]
    assert "ReadSchema: struct<message:string>" in plan


@settings(max_examples=40, deadline=None)
@given(
    st.datetimes(datetime(2023, 12, 28), datetime(2024, 3, 2)),
    st.integers(0, 4000),
)
def test_globs_cover_the_minutes_and_no_others(start, minutes):
    end = start + timedelta(minutes=minutes)
    globs = []
    for glob in tables.minute_globs(start, end):
        options = re.search(r"\{(.*?)\}", glob)
        names = options.group(1).split(",") if options else [None]
        folders = [glob if n is None else glob.replace(options.group(0), n) for n in names]
        # A unit's folder stands for all that is below it.
        globs += [f if "minute=" in f else f"{f}/*" for f in folders]
    assert len(tables.minute_globs(start, end)) <= 9
    regex = re.compile("|".join(f"(?:{fnmatch.translate(g)})" for g in globs))
    first = start.replace(second=0, microsecond=0)
    for i in range(-90, minutes + 90):
        at = first + timedelta(minutes=i)
        path = at.strftime("year=%Y/month=%m/day=%d/hour=%H/minute=%M")
        assert bool(regex.match(path)) == (first <= at <= end), path


@pytest.mark.parametrize("levels", [0, 1, 3, 9])
def test_objects_of_a_table(spark, root, levels):
    objects = listing.list_objects(spark, root, spread_levels=levels).collect()
    on_disk = {
        str(f.relative_to(root)): f.stat().st_size
        for f in Path(root).rglob("*.parquet")
    }
    assert {r.path: r.length for r in objects} == on_disk and len(objects) == len(on_disk)
    assert all(r.modification_time.year > 2020 for r in objects)


def test_objects_of_a_prefix(spark, root):
    prefix = "service_name=007/year=2024/month=01/day=0"
    paths = [r.path for r in listing.list_objects(spark, root, prefix).collect()]
    assert paths and all(p.startswith(prefix) for p in paths)
    everything = [r.path for r in listing.list_objects(spark, root).collect()]
    assert sorted(paths) == sorted(p for p in everything if p.startswith(prefix))
    assert listing.list_objects(spark, root, "service_name=00").count() == len(
        [p for p in everything if p.startswith("service_name=00")]
    )


def test_absent_folders_have_no_objects(spark, root):
    with pytest.raises(Exception, match="[Nn]o such file|does not exist|cannot find"):
        listing.list_objects(spark, root + "-absent").count()
    folders = spark.createDataFrame([("service_name=absent",), ("service_name=api",)], "path string")
    assert listing.list_folders(root, folders).count() > 0
    assert {r.path for r in listing.list_top_folders(spark, root).collect()} >= {"service_name=api/"}


def test_extra_and_missing_columns(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame(
        [("m", "2024-01-01T00:00:00Z", "s", "prod", "warn")],
        "message string, timestamp string, service_name string, env string, log_level string",
    )
    sink.write_logs(sink.with_time_partitions(rows), folder, ["env", *model.PARTITION_COLUMNS])
    extra = model.schema_of("log_level string, env string, added_later string")
    row = tables.read_logs(spark, folder, extra).first()
    assert (row.env, row.log_level, row.added_later, row.source_type) == ("prod", "warn", None, None)


def test_replaced_table_is_read_as_a_whole(spark, tmp_path):
    folder, schema = str(tmp_path / "meta"), model.OVERRIDE_SCHEMA
    assert versioned.read_table(spark, folder, schema).count() == 0
    first = spark.createDataFrame([("a", True, None), ("b", None, False)], schema)
    assert versioned.replace_table(first, folder) == 1
    current = versioned.read_table(spark, folder, schema)
    assert versioned.replace_table(current.where("tenant = 'a'"), folder) == 2
    assert [tuple(r) for r in versioned.read_table(spark, folder, schema).collect()] == [("a", True, None)]
    assert versioned.replace_table(first.limit(0), folder) == 3
    assert versioned.read_table(spark, folder, schema).count() == 0


def test_uncommitted_version_is_not_seen(spark, tmp_path):
    folder, schema = str(tmp_path / "meta"), model.OVERRIDE_SCHEMA
    versioned.replace_table(spark.createDataFrame([("a", True, None)], schema), folder)
    lost = spark.createDataFrame([("lost", True, None)], schema)
    lost.write.parquet(f"{folder}/data/0000000002-deadbeef")
    assert [r.tenant for r in versioned.read_table(spark, folder, schema).collect()] == ["a"]


def test_queue_options_leave_out_what_is_not_set():
    options = kafka.QueueOptions("broker:9092", max_offsets_per_trigger=5)
    assert options.to_spark() == {
        "kafka.bootstrap.servers": "broker:9092",
        "maxOffsetsPerTrigger": "5",
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
        "groupIdPrefix": "application-logs",
        "subscribePattern": "^logs.*",
    }
    replay = kafka.replay_options(options, 1_700_000_000_000).to_spark()
    assert replay["startingTimestamp"] == "1700000000000" and "startingOffsets" not in replay


def test_topics_are_routed_by_service(spark):
    df = spark.createDataFrame([("m", "t", "api")], model.INGEST_SCHEMA)
    assert sink.route_topics(df).first().topic == "logs.api"


def test_lines_of_a_file_in_many_splits_keep_their_order(spark, tmp_path):
    plain = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(plain) + "\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("\n".join(plain[:100]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = files.read_text_lines(spark, f"{tmp_path}/*.log*")
        numbered = files.number_lines(lines).orderBy("file_name", "line_no").collect()
        assert lines.select("block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in numbered] == plain + plain[:100]
    assert [r.line_no for r in numbered] == [*range(5000), *range(100)]


def test_old_files_can_be_skipped(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n")
    assert files.read_text_lines(spark, str(tmp_path), modified_since="2000-01-01").count() == 1
    assert files.read_text_lines(spark, str(tmp_path), modified_since="2100-01-01").count() == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"message": "m", "service_name": "s"}\n{"message": \n[1]\n')
    schema = model.schema_of("message string, service_name string")
    rows = files.read_json_lines(spark, str(tmp_path), schema).collect()
    got = sorted((r.message or "", r.service_name or "", r.corrupt_record or "") for r in rows)
    assert got == [("", "", "[1]"), ("", "", '{"message": '), ("m", "s", "")]


def test_raw_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    assert {r.message for r in files.read_raw_lines(spark, str(tmp_path)).collect()} == {"one", "two"}


def test_syslog_lines(spark):
    lines = [
        "<34>Oct 11 22:14:15 mymachine su[231]: 'su root' failed",
        "<13>Oct  1 02:14:15 host app: text",
        "<165>1 2003-10-11T22:14:15.003Z host evntslog - ID47 [ex@1 a=\"b\"][c@2 d=\"e\"] An event",
        "<14>1 2003-10-11T22:14:15Z host app 12 - - plain",
        "no syslog at all",
        "<14>Oct 11 22:14:15 h a: " + "x" * 200,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, value string")
    rows = {r.id: r for r in files.parse_syslog(df, max_bytes=150).collect()}
    assert rows[5].oversized and rows[5].message == "x" * 200 and not rows[0].oversized
    assert (rows[2].message_id, rows[2].structured_data) == ("ID47", '[ex@1 a="b"][c@2 d="e"]')
    assert (rows[3].message_id, rows[3].structured_data, rows[0].message_id) == (None, None, None)
    assert (rows[0].facility, rows[0].severity, rows[0].hostname) == (4, "crit", "mymachine")
    assert (rows[0].app_name, rows[0].process_id, rows[0].message) == ("su", "231", "'su root' failed")
    assert (rows[1].app_name, rows[1].process_id, rows[1].message) == ("app", None, "text")
    assert (rows[2].severity, rows[2].process_id, rows[2].message) == ("notice", None, "An event")
    assert rows[2].syslog_time == "2003-10-11T22:14:15.003Z"
    assert (rows[3].process_id, rows[3].message) == ("12", "plain")
    assert (rows[4].parsed, rows[4].message, rows[4].severity) == (False, "no syslog at all", None)
    left = {r.id for r in files.parse_syslog(df, max_bytes=150, on_oversized="drop").collect()}
    assert left == {0, 1, 2, 3, 4}


def test_syslog_files(spark, tmp_path):
    (tmp_path / "sys.log").write_text("<34>Oct 11 22:14:15 mymachine su: failed\n" + "x" * 102_401 + "\n")
    rows = files.read_syslog_lines(spark, str(tmp_path)).collect()
    got = [(r.hostname, len(r.message), r.file_name, r.oversized) for r in rows]
    assert got == [("mymachine", 6, "sys.log", False), (None, 102_401, "sys.log", True)]
