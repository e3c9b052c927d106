from datetime import datetime, timedelta

import pytest

from tidelog import model
from tidelog.operators import history, offsets
from tidelog.plans import partition_sizing, worker_sizing

T0 = datetime(2024, 1, 1)


def runs_of(spark, **series):
    """Runs per tenant, record counts newest first."""
    rows = []
    for tenant, counts in series.items():
        for i, n in enumerate(reversed(counts)):
            rows.append((1, n, i * 60_000, i * 60_000 + 5, 4, "succeeded", tenant, T0 + timedelta(minutes=i)))
    return spark.createDataFrame(rows, model.RUN_SCHEMA)


def one(spark, table_schema, **values):
    return spark.createDataFrame([tuple(values.values())], table_schema)


@pytest.mark.parametrize(
    "counts, number, expected",
    [
        ([5000, 4900, 4800, 4700, 4600], 0, 2),
        ([1000] * 5, 0, 1),
        ([1000] * 5, 7, 1),
        ([8000] * 5, 7, 3),
        ([1000, 1100, 1200, 1300, 1400], 0, 1),
        ([5000, 4900, 4800, 4700], 0, None),
        ([100, 0, 0, 0, 0], 0, 1),
        ([0] * 5, 0, None),
    ],
)
def test_expected_workers(spark, counts, number, expected):
    logs = spark.createDataFrame([("t", number, False)], "tenant string, number bigint, compacted boolean")
    row = worker_sizing.expected_workers(runs_of(spark, t=counts), logs, per_core=1000, cores_per_machine=4).first()
    assert row.expected == expected


def test_growth_adds_to_the_records_to_plan_for(spark):
    series = history.tenant_series(runs_of(spark, t=[5000, 4900, 4800, 4700, 4600])).first()
    assert series.buffer_share == pytest.approx(0.021064, abs=1e-6)
    falling = history.tenant_series(runs_of(spark, t=[4600, 4700, 4800, 4900, 5000])).first()
    assert (falling.buffer_share, falling.rising) == (0.0, False)


def test_only_the_latest_runs_count(spark):
    series = history.tenant_series(runs_of(spark, t=[1, 2, 3, 4, 5, 99], u=[7])).collect()
    assert {r.tenant: r.records for r in series} == {"t": [1, 2, 3, 4, 5], "u": [7]}


def test_average_growth(spark):
    rows = history.average_growth(runs_of(spark, a=[300, 200, 100], b=[100, 200, 300], c=[100], d=[1, 0])).collect()
    got = {r.tenant: round(r.average_growth, 5) for r in rows}
    assert got == {"a": 0.75, "b": -0.41667, "c": 0, "d": 0}


def test_latest_runs_limit_rows_before_the_shuffle(spark):
    plan = history.latest_runs(runs_of(spark, a=[1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize(
    "number, compacted, override, request_, expected",
    [
        (0, False, (None, None), (True, True), ("down", 7)),
        (8, False, (None, None), (True, True), ("none", 10)),
        (9, True, (None, None), (True, True), ("none", 10)),
        (0, False, (None, False), (True, True), ("none", 10)),
        (0, False, (None, True), (True, False), ("down", 7)),
        (0, False, (False, False), (True, True), ("none", 10)),
    ],
)
def test_recommended_workers(spark, number, compacted, override, request_, expected):
    got = worker_sizing.recommend_workers(
        runs_of(spark, t=[1000] * 5),
        spark.createDataFrame([("t", number, compacted)], "tenant string, number bigint, compacted boolean"),
        spark.createDataFrame([("t", 10)], "tenant string, actual int"),
        spark.createDataFrame([("t", *request_)], model.OVERRIDE_SCHEMA),
        spark.createDataFrame([("t", *override)], model.OVERRIDE_SCHEMA),
        per_core=1000,
    ).first()
    assert (got.action, got.target) == expected


def test_no_override_row_keeps_the_request(spark):
    requests = spark.createDataFrame([("t", True, False)], model.OVERRIDE_SCHEMA)
    none = spark.createDataFrame([], model.OVERRIDE_SCHEMA)
    assert tuple(worker_sizing.resolve_switches(requests, none).first()) == ("t", True, False)


def test_run_rollup_and_counters(spark):
    rows = [
        ("r1", "a", "completed", "succeeded", 10, 100, 5, 50),
        ("r1", "a", "completed", "succeeded", 20, 50, None, 70),
        ("r1", "b", "completed", "failed", 99, 999, 1, 99),
        ("r2", "b", "submitted", "succeeded", 1, 1, 7, None),
    ]
    stages = spark.createDataFrame(
        rows,
        "run_id string, stage_name string, event string, status string, records_read bigint, "
        "bytes_written bigint, submission_time bigint, completion_time bigint",
    )
    assert {tuple(r) for r in history.run_rollup(stages).collect()} == {("r1", 20, 100, 5, 70), ("r2", 1, 1, 7, None)}
    counters = history.stage_counters(stages)
    got = {tuple(r) for r in counters.collect()}
    assert got == {("a", 0, 2, True), ("b", 1, 1, True)}
    assert history.all_completed_once(counters, 2).first()[0] is True
    assert history.all_completed_once(counters, 3).first()[0] is False
    pending = history.stage_counters(stages.where("status = 'succeeded'"))
    assert history.all_completed_once(pending, 1).first()[0] is False
    assert history.all_completed_once(counters.limit(0), 0).first()[0] is False


def snapshots(spark, topic, *points, partitions=3):
    rows = [
        (topic, p, total // partitions + (total % partitions if p == 0 else 0), T0 + timedelta(seconds=at))
        for at, total in points
        for p in range(partitions)
    ]
    return spark.createDataFrame(rows, model.OFFSET_SCHEMA)


def test_required_partitions(spark):
    rows = snapshots(spark, "logs.service1", (0, 100_000), (60, 1_100_000))
    got = partition_sizing.recommend_partitions(rows, per_partition=1000).collect()
    assert [(r.topic, r.rate, r.partitions, r.required_partitions) for r in got] == [("logs.service1", 16666, 3, 17)]


@pytest.mark.parametrize("gap, valid", [(30, False), (31, True), (300, True), (301, False)])
def test_snapshot_gap(spark, gap, valid):
    sums = offsets.offset_sums(snapshots(spark, "t", (0, 0), (gap, 10**9)))
    flags = [r.valid for r in offsets.offset_rates(sums).orderBy("captured_at").collect()]
    assert flags == [False, valid]


def test_enough_partitions_need_no_more(spark):
    rows = snapshots(spark, "logs.a", (0, 0), (60, 3 * 2000 * 60))
    assert partition_sizing.recommend_partitions(rows).count() == 0


def test_topics_match_as_a_whole(spark):
    rows = snapshots(spark, "logs.a", (0, 1)).unionByName(snapshots(spark, "my.logs.a", (0, 1)))
    assert [r.topic for r in offsets.matching_topics(rows).collect()] == ["logs.a"]
    assert [r.topic for r in offsets.matching_topics(rows, "my").collect()] == []
    assert offsets.matching_topics(rows, None).count() == offsets.matching_topics(rows, "").count() == 2


def test_absent_topics_and_offsets_count_as_zero(spark):
    rows = spark.createDataFrame([("a", 0, 5, T0), ("a", 1, None, T0), ("n", 0, None, T0)], model.OFFSET_SCHEMA)
    topics = spark.createDataFrame([("a",), ("n",), ("gone",)], "topic string")
    got = {tuple(r) for r in offsets.offsets_of_topics(topics, offsets.offset_sums(rows)).collect()}
    assert got == {("a", 5, 2), ("n", 0, 1), ("gone", 0, 0)}


def test_consumer_lag(spark):
    ends = spark.createDataFrame([("a", 0, 100), ("a", 1, 51)], "topic string, partition int, end_offset bigint")
    committed = spark.createDataFrame([("a", 0, 90)], "topic string, partition int, committed_offset bigint")
    assert tuple(offsets.consumer_lag(ends, committed).first()) == ("a", 61, 2, 30)
