from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.operators import catalog, freshness, maintenance
from tidelog.plans import catalog_sync
from tidelog.sinks import logs as sink
from tidelog.sinks import versioned
from tidelog.sources import listing, tables

OLD, NOW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def catalog_of(spark, *rows):
    return spark.createDataFrame([(n, d, t, OLD) for n, d, t in rows], model.SERVICE_SCHEMA)


def found_of(spark, *names, tenant="ABC"):
    df = spark.createDataFrame([(n,) for n in names], "service_name string")
    return catalog.stamp_defaults(df, tenant)


def as_set(df):
    return {(r.service_name, r.retention_days, r.tenant, r.last_checked_at) for r in df.collect()}


@pytest.mark.parametrize(
    "known, found, actions",
    [
        ([], ["a", "b"], {"a": "insert", "b": "insert"}),
        (["a"], [], {"a": "delete"}),
        (["a", "b"], ["b", "c"], {"a": "delete", "b": "keep", "c": "insert"}),
        (["a"], ["a", "a"], {"a": "keep"}),
        ([], [], {}),
    ],
)
def test_sync_plan(spark, known, found, actions):
    plan = catalog.sync_plan(found_of(spark, *found), catalog_of(spark, *[(n, 30, "ABC") for n in known]))
    assert {r.service_name: r.action for r in plan.collect()} == actions


def test_sync_leaves_services_of_both_sides_untouched(spark):
    current = catalog_of(spark, ("a", 30, "ABC"), ("gone", 30, "ABC"))
    synced = catalog_sync.synced_catalog(found_of(spark, "a", "new"), current, F.lit(NOW))
    assert as_set(synced) == {("a", 30, "ABC", OLD), ("new", 3, "ABC", NOW)}


def test_upsert_moves_only_the_check_time(spark):
    current = catalog_of(spark, ("a", 30, "ABC"), ("b", 30, "ABC"), ("a", 9, "XYZ"))
    services = found_of(spark, "a", "c", "c")
    upserted = catalog.upsert_services(current, services, F.lit(NOW))
    assert as_set(upserted) == {
        ("a", 30, "ABC", NOW), ("b", 30, "ABC", OLD), ("a", 9, "XYZ", OLD), ("c", 3, "ABC", NOW),
    }
    untouched = catalog.upsert_services(current, services, F.lit(NOW), touch=False)
    assert ("a", 30, "ABC", OLD) in as_set(untouched)


def test_deletions(spark):
    current = catalog_of(spark, ("a", 30, "ABC"), ("a", 9, "XYZ"), ("b", 3, "ABC"))
    gone = catalog.services_of(["a"], "ABC", current)
    assert as_set(catalog.delete_services(current, gone)) == {("a", 9, "XYZ", OLD), ("b", 3, "ABC", OLD)}
    assert as_set(catalog.delete_stale(current, "ABC", F.lit(OLD))) == {("a", 9, "XYZ", OLD)}
    assert catalog.delete_stale(current, "ABC", F.lit(datetime(2023, 1, 1))).count() == 3


def test_overrides(spark):
    current = spark.createDataFrame([("a", True, None), ("b", False, False)], model.OVERRIDE_SCHEMA)
    changes = spark.createDataFrame([("a", None, True), ("c", True, True)], model.OVERRIDE_SCHEMA)
    got = {tuple(r) for r in catalog.upsert_overrides(current, changes).collect()}
    assert got == {("a", None, True), ("b", False, False), ("c", True, True)}


def test_picker_ignores_case(spark):
    listed = catalog.picker_list(catalog_of(spark, ("b", 1, "t"), ("A", 1, "t"), ("C", 1, "t")))
    assert [r.service_name for r in listed.collect()] == ["A", "b", "C"]


def test_stored_catalogue_follows_the_log_table(spark, tmp_path):
    logs, stored = str(tmp_path / "logs"), str(tmp_path / "catalog")
    rows = [("m", "2024-01-01T00:00:00Z", s) for s in ("a", "b", model.DEAD_LETTER_SERVICE)]
    sink.write_logs(sink.with_time_partitions(spark.createDataFrame(rows, model.INGEST_SCHEMA)), logs)
    versioned.replace_table(catalog_of(spark, ("b", 30, "ABC"), ("old", 30, "ABC"), ("x", 1, "XYZ")), stored)
    objects = listing.list_objects(spark, logs)
    for version in (2, 3):
        assert catalog_sync.sync_services(spark, objects, stored, "ABC", now=F.lit(NOW)) == version
        assert as_set(versioned.read_table(spark, stored, model.SERVICE_SCHEMA)) == {
            ("a", 3, "ABC", NOW), ("b", 30, "ABC", OLD), ("x", 1, "XYZ", OLD),
        }


def seconds(*args):
    return int((datetime(*args) - datetime(1970, 1, 1)).total_seconds())


def key(service, *at):
    t = datetime(*at)
    return f"logs/service_name={service}/{t:year=%Y/month=%m/day=%d/hour=%H/minute=%M}/part-0"


@pytest.fixture(scope="module")
def objects(spark):
    paths = [
        key("midnight", 2024, 1, 1, 23, 50),
        key("recent", 2024, 1, 2, 0, 9),
        key("recent", 2024, 1, 1, 22, 0),
        key("old", 2024, 1, 1, 20, 0),
        key("same hour of another day", 2023, 12, 25, 0, 5),
        key("ahead", 2024, 1, 2, 3, 0),
        "logs/readme.txt",
    ]
    rows = [(p, 10, OLD) for p in paths]
    return spark.createDataFrame(rows, model.OBJECT_SCHEMA)


def test_sync_delay(spark, objects):
    names = ["midnight", "recent", "old", "same hour of another day", "ahead", "none"]
    services = spark.createDataFrame([(n,) for n in names], "service_name string")
    now = F.lit(seconds(2024, 1, 2, 0, 10)).cast("bigint")

    def delays(**kwargs):
        rows = freshness.sync_delay(services, objects, now, **kwargs).collect()
        return {r.service_name: r.delay_minutes for r in rows}

    assert delays() == {
        "midnight": 20, "recent": 1, "old": 180, "same hour of another day": 180, "ahead": 180, "none": 180,
    }
    # By clock alone 23:50 lies after 00:10, and the difference is raised to 1.
    assert delays(legacy_clock=True)["midnight"] == 1


def test_recent_objects_are_of_this_hour_not_of_any_day(objects):
    now = F.lit(seconds(2024, 1, 2, 0, 10)).cast("bigint")
    recent = freshness.recent_objects(objects, now).collect()
    assert {r.path for r in recent} == {key("midnight", 2024, 1, 1, 23, 50), key("recent", 2024, 1, 2, 0, 9)}
    counts = freshness.object_counts(objects, "logs/", now)
    assert tuple(counts.first()) == (2, 5)
    assert freshness.freshness_check(counts).first().status == "UP"
    later = freshness.object_counts(objects, "logs/", F.lit(seconds(2025, 1, 1)).cast("bigint"))
    assert freshness.freshness_check(later).first().status == "WARNING"
    assert freshness.newest_key(objects).first().path == key("same hour of another day", 2023, 12, 25, 0, 5)


@pytest.mark.parametrize("statuses, overall", [(["UP", "UP"], "UP"), (["UP", "WARNING"], "DOWN"), ([], "DOWN")])
def test_overall_status(spark, statuses, overall):
    checks = spark.createDataFrame([(s,) for s in statuses], "status string")
    assert freshness.overall_status(checks).first().status == overall


def test_hour_prefixes_cross_midnight(spark):
    services = spark.createDataFrame([("s",), ("s",)], "service_name string")
    now = F.lit(seconds(2024, 1, 1, 1, 30)).cast("bigint")
    got = {r.prefix for r in freshness.hour_prefixes(services, now).collect()}
    assert got == {
        f"service_name=s/year={y}/month={m}/day={d}/hour={h}/minute="
        for y, m, d, h in [
            ("2024", "01", "01", "01"), ("2024", "01", "01", "00"), ("2023", "12", "31", "23"), ("2023", "12", "31", "22"),
        ]
    }


def test_delay_needs_only_the_latest_folders(spark, tmp_path):
    root = str(tmp_path / "logs")
    times = ["2024-01-01T23:50:00Z", "2024-01-02T00:05:10Z", "2024-01-01T10:00:00Z"]
    rows = [("m", t, s) for t, s in zip(times, ("a", "b", "old"))]
    sink.write_logs(sink.with_time_partitions(spark.createDataFrame(rows, model.INGEST_SCHEMA)), root)
    services = catalog.discover_from_keys(listing.list_top_folders(spark, root))
    now = F.lit(seconds(2024, 1, 2, 0, 10)).cast("bigint")
    objects = listing.list_folders(root, freshness.hour_folders(services, now))
    assert objects.count() == 2
    delays = {r.service_name: r.delay_minutes for r in freshness.sync_delay(services, objects, now).collect()}
    assert delays == {"a": 20, "b": 5, "old": 180}


def test_retention(spark):
    paths = [key("a", 2024, 1, 10, 5, 0), key("a", 2024, 1, 10, 6, 0), key("a", 2024, 1, 28, 5, 0), key("b", 2024, 1, 28, 5, 0), key("b", 2024, 1, 29, 5, 0)]
    objects = spark.createDataFrame([(p, 10, OLD) for p in paths], model.OBJECT_SCHEMA)
    expired = maintenance.expired_partitions(
        objects, catalog_of(spark, ("a", 15, "ABC")), F.lit("2024-02-01").cast("date")
    )
    got = {(r.service_name, str(r.day), r.objects, r.bytes) for r in expired.collect()}
    assert got == {("a", "2024-01-10", 2, 20), ("b", "2024-01-28", 1, 10)}
    in_env = spark.createDataFrame(
        [(f"logs/env=prod/{p.removeprefix('logs/')}", 10, OLD) for p in paths]
        + [(key(model.DEAD_LETTER_SERVICE, 2020, 1, 1, 0, 0), 1, OLD), (key("b", 1970, 1, 1, 0, 0), 1, OLD)],
        model.OBJECT_SCHEMA,
    )
    expired = maintenance.expired_partitions(in_env, catalog_of(spark, ("a", 15, "ABC")), F.lit("2024-02-01").cast("date"))
    assert {(r.service_name, str(r.day)) for r in expired.collect()} == {("a", "2024-01-10")}
    envs = spark.createDataFrame([("prod",), ("dev",), (None,)], "env string")
    assert [r[0] for r in envs.select(maintenance.retention_of_env(F.col("env"))).collect()] == [30, 3, 3]


def test_compaction(spark, tmp_path):
    root, target = str(tmp_path / "logs"), str(tmp_path / "compact")
    for i in range(3):
        rows = [(f"m{i}{d}", f"2024-01-0{d}T00:00:00Z", s) for d in (1, 2) for s in ("a", "")]
        sink.write_logs(sink.with_time_partitions(spark.createDataFrame(rows, model.INGEST_SCHEMA)), root)
    small = maintenance.small_file_partitions(listing.list_objects(spark, root)).collect()
    assert {(r.files, r.needed_files) for r in small} == {(3, 1)} and len(small) == 4
    maintenance.compact_table(spark, root, target, days=[("2024", "01", "01")])
    assert maintenance.small_file_partitions(listing.list_objects(spark, target)).count() == 0
    maintenance.compact_table(spark, root, target, days=[("2024", "01", "01")])
    left = tables.read_logs(spark, root).where("day = '01'").exceptAll(tables.read_logs(spark, target))
    assert left.count() == 0 and tables.read_logs(spark, target).count() == 6


def test_compaction_keeps_all_columns(spark, tmp_path):
    root, target = str(tmp_path / "logs"), str(tmp_path / "compact")
    plain = spark.createDataFrame([("m1", "2024-01-01T00:00:00Z", "a")], model.INGEST_SCHEMA)
    sink.write_logs(sink.with_time_partitions(plain), root)
    sink.write_logs(sink.with_time_partitions(plain.withColumn("log_level", F.lit("warn"))), root)
    for _ in range(2):
        maintenance.compact_table(spark, root, target)
    rows = tables.read_logs(spark, target, model.schema_of("log_level string")).select("message", "log_level").collect()
    assert sorted((r.message, r.log_level or "") for r in rows) == [("m1", ""), ("m1", "warn")]


def test_a_wrong_root_is_an_error(spark, tmp_path):
    stored = str(tmp_path / "catalog")
    versioned.replace_table(catalog_of(spark, ("a", 3, "ABC")), stored)
    with pytest.raises(Exception, match="[Nn]o such file|does not exist|cannot find"):
        catalog_sync.sync_services(spark, listing.list_top_folders(spark, str(tmp_path / "absent")), stored, "ABC")
    assert versioned.read_table(spark, stored, model.SERVICE_SCHEMA).count() == 1


def test_two_writers(spark, tmp_path):
    stored = str(tmp_path / "catalog")
    one, other = catalog_of(spark, ("a", 3, "ABC")), catalog_of(spark, ("b", 3, "ABC"))
    version = versioned.current_version(spark, stored)
    versioned.replace_table(one, stored, version)
    with pytest.raises(versioned.VersionConflict):
        versioned.replace_table(other, stored, version)
    assert [r.service_name for r in versioned.read_table(spark, stored, model.SERVICE_SCHEMA).collect()] == ["a"]


def test_escaped_services_agree_with_the_table(spark, tmp_path):
    root = str(tmp_path / "logs")
    names = ["api:v2", "a/b", "50%", "x=y", "plain"]
    rows = [("m", "2024-01-02T00:05:10Z", s) for s in names]
    sink.write_logs(sink.with_time_partitions(spark.createDataFrame(rows, model.INGEST_SCHEMA)), root)
    from_keys = catalog.discover_from_keys(listing.list_top_folders(spark, root))
    from_table = catalog.discover_services(tables.read_logs(spark, root))
    assert {r[0] for r in from_keys.collect()} == {r[0] for r in from_table.collect()} == set(names)
    now = F.lit(seconds(2024, 1, 2, 0, 10)).cast("bigint")
    objects = listing.list_folders(root, freshness.hour_folders(from_keys, now))
    delays = {r.service_name: r.delay_minutes for r in freshness.sync_delay(from_keys, objects, now).collect()}
    assert delays == dict.fromkeys(names, 5)
    expired = maintenance.expired_partitions(
        listing.list_objects(spark, root), catalog_of(spark, ("api:v2", 100, "ABC")), F.lit("2024-02-01").cast("date")
    )
    assert {r.service_name for r in expired.collect()} == set(names) - {"api:v2"}
