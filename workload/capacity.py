"""Queries on run history, stage events, sink logs, topic offsets and sizing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import sizing, timefmt
from tidelog.operators import adjacent, catalog, history, maintenance, offsets
from tidelog.plans import partition_sizing, worker_sizing
from tidelog.session import work_folder
from tidelog.sinks import versioned
from tidelog.sources import tables
from workload import derive
from workload.registry import query

R = f"WITH {derive.RUNS} "
S = f"WITH {derive.SERIES} "
G = f"WITH {derive.STAGES} "
T = f"WITH {derive.TENANTS} "
OFF = f"WITH {derive.OFFSETS} "
_RUN = "tenant, submission_time, completion_time, input_records, output_bytes, cores_used, status"
_RUN_COLUMNS = _RUN.split(", ")


# Run history


@query(
    "a8_tenant_history",
    R + f"SELECT {_RUN} FROM runs WHERE tenant = '1-URGENT-F'",
)
def _(spark, sf):
    return tables.tenant_rows(derive.runs(spark, sf), "1-URGENT-F").select(*_RUN_COLUMNS)


@query("b6_history_append", R + f"SELECT {_RUN} FROM runs")
def _(spark, sf):
    """Two appends, read back as one table."""
    root = work_folder(spark, "history")
    rows = derive.runs(spark, sf).select(*model.RUN_SCHEMA.fieldNames())
    early = F.col("submission_time") < 883612800000
    versioned.append_rows(rows.where(early), root)
    versioned.append_rows(rows.where(~early), root)
    return spark.read.schema(model.RUN_SCHEMA).parquet(root).select(*_RUN_COLUMNS)


@query(
    "b7_override_upsert",
    T + """SELECT tenant, CASE WHEN r.tenant IS NULL THEN o.upscale ELSE r.upscale END AS upscale,
  CASE WHEN r.tenant IS NULL THEN o.downscale ELSE r.downscale END AS downscale
FROM overrides o FULL JOIN (SELECT * FROM requests WHERE upscale) r USING (tenant)""",
)
def _(spark, sf):
    changes = derive.requests(spark, sf).where("upscale")
    return catalog.upsert_overrides(derive.overrides(spark, sf), changes)


@query(
    "f3_run_rollup",
    G + """SELECT run_id, max(records_read) AS input_records, max(bytes_written) AS output_bytes,
  min(submission_time) AS submission_time, max(completion_time) AS completion_time
FROM stages WHERE status = 'succeeded' GROUP BY run_id""",
)
def _(spark, sf):
    return history.run_rollup(derive.stage_events(spark, sf))


_COUNTERS = """SELECT stage_name, count(*) FILTER (WHERE event = 'submitted') AS submitted,
  count(*) FILTER (WHERE event = 'completed') AS completed,
  count(*) FILTER (WHERE event = 'completed') > 0 AS completed_once
FROM stages GROUP BY stage_name"""


@query("f4_stage_counters", G + _COUNTERS)
def _(spark, sf):
    return history.stage_counters(derive.stage_events(spark, sf))


@query(
    "f4_all_completed",
    G + f"""SELECT count(*) FILTER (WHERE completed > 0) = 3 AND bool_and(completed > 0) AS all_completed
FROM ({_COUNTERS})""",
)
def _(spark, sf):
    counters = history.stage_counters(derive.stage_events(spark, sf))
    return history.all_completed_once(counters, expected_streams=3)


@query("f5_max_records", S + "SELECT tenant, max_records, n_runs FROM series")
def _(spark, sf):
    return history.tenant_series(derive.runs(spark, sf)).select(
        "tenant", "max_records", F.col("n_runs").cast("bigint").alias("n_runs")
    )


_GROWTH = """growth AS (
  SELECT tenant, submission_time, input_records, previous_records,
    CAST(input_records - previous_records AS DOUBLE) / nullif(previous_records, 0) AS growth
  FROM (SELECT *, lag(input_records) OVER (PARTITION BY tenant ORDER BY submission_time)
    AS previous_records FROM runs))"""


@query(
    "f6_average_growth",
    f"WITH {derive.RUNS}, {_GROWTH} SELECT tenant, round(coalesce(avg(growth), 0), 6) AS average_growth "
    "FROM growth GROUP BY tenant",
)
def _(spark, sf):
    rates = history.average_growth(derive.runs(spark, sf))
    return rates.withColumn("average_growth", F.round("average_growth", 6))


@query("f6_recent_growth", S + "SELECT tenant, round(growth, 6) AS growth FROM facts")
def _(spark, sf):
    series = history.tenant_series(derive.runs(spark, sf))
    return series.select("tenant", F.round(history.series_growth(F.col("records")), 6).alias("growth"))


@query(
    "g1_run_growth",
    f"WITH {derive.RUNS}, {_GROWTH} SELECT tenant, submission_time, input_records, previous_records, "
    "round(growth, 6) AS growth FROM growth",
)
def _(spark, sf):
    return history.run_growth(derive.runs(spark, sf)).select(
        "tenant",
        "submission_time",
        "input_records",
        "previous_records",
        F.round("growth", 6).alias("growth"),
    )


@query("g2_rising_runs", S + "SELECT tenant, rising FROM facts")
def _(spark, sf):
    return history.tenant_series(derive.runs(spark, sf)).select("tenant", "rising")


@query("g3_newest_is_largest", S + "SELECT tenant, newest_is_largest FROM facts")
def _(spark, sf):
    return history.tenant_series(derive.runs(spark, sf)).select("tenant", "newest_is_largest")


@query(
    "g6_latest_runs",
    R + f"""SELECT {_RUN}, CAST(n AS INTEGER) AS run_no FROM (SELECT *,
  row_number() OVER (PARTITION BY tenant ORDER BY submission_time DESC) AS n FROM runs) WHERE n <= 5""",
)
def _(spark, sf):
    return history.latest_runs(derive.runs(spark, sf)).select(*_RUN_COLUMNS, "run_no")


@query(
    "h2_newest_runs",
    R + f"SELECT {_RUN} FROM runs WHERE tenant = '2-HIGH-O' ORDER BY submission_time DESC LIMIT 5",
)
def _(spark, sf):
    mine = tables.tenant_rows(derive.runs(spark, sf), "2-HIGH-O")
    return history.newest_runs(mine, 5).select(*_RUN_COLUMNS)


@query("h3_runs_by_submission", R + f"SELECT {_RUN} FROM runs ORDER BY submission_time DESC, tenant DESC")
def _(spark, sf):
    return history.by_submission(derive.runs(spark, sf)).select(*_RUN_COLUMNS)


# Sink logs


@query(
    "d10_sink_log_files",
    f"WITH {derive.SINK_LOGS} SELECT tenant, name, number FROM sink_logs",
)
def _(spark, sf):
    """The log files out of a listing that also has other files of the same folders."""
    listed = derive.sink_logs(spark, sf)
    other = listed.withColumn("path", F.concat("path", F.lit(".tmp.crc")))
    stray = listed.withColumn("path", F.regexp_replace("path", r"/\d+([^/]*)$", "/abc$1"))
    files = maintenance.sink_log_files(listed.unionByName(stray).unionByName(
        other.where(~F.col("path").contains(".compact"))
    ))
    return files.select("tenant", "name", "number")


@query(
    "f7_latest_sink_log",
    f"WITH {derive.SINK_LOGS} SELECT arg_max(name, number) AS name, max(number) AS number, "
    "contains(arg_max(name, number), '.compact') AS compacted, tenant FROM sink_logs GROUP BY tenant",
)
def _(spark, sf):
    return maintenance.latest_sink_log(maintenance.sink_log_files(derive.sink_logs(spark, sf)), by=["tenant"])


def _log_numbers(spark, sf) -> DataFrame:
    """Each tenant's latest sink log number and whether that file is compacted."""
    files = maintenance.sink_log_files(derive.sink_logs(spark, sf))
    return maintenance.latest_sink_log(files, by=["tenant"]).select("tenant", "number", "compacted")


@query(
    "i1_stream_state_files",
    f"WITH {derive.SINK_LOGS} SELECT 'checkpoint/' || tenant || '/offsets/' || number AS path, "
    "'checkpoint' AS kind FROM sink_logs "
    "UNION ALL SELECT 'logs/' || tenant || '/_spark_metadata/' || name, 'sink_log' FROM sink_logs",
)
def _(spark, sf):
    listed = derive.sink_logs(spark, sf)
    number = F.regexp_extract("path", r"/(\d+)[^/]*$", 1)
    checkpoint = listed.withColumn(
        "path", F.concat(F.lit("checkpoint/"), "tenant", F.lit("/offsets/"), number)
    )
    return maintenance.stream_state_files(checkpoint, listed).select("path", "kind")


# Topic offsets


@query(
    "a4_topic_discovery",
    OFF + r"SELECT DISTINCT topic FROM offsets WHERE regexp_full_match(topic, 'logs\.(e|p|v).*r')",
)
def _(spark, sf):
    return offsets.matching_topics(derive.offsets(spark, sf), r"logs\.(e|p|v).*r")


_SUM = "topic, snapshot * 1000 AS captured_millis, sum_of_end_offsets, partitions"


def _captured(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("topic", F.unix_millis("captured_at").alias("captured_millis"), *columns)


@query("f2_offset_sums", OFF + f"SELECT {_SUM} FROM sums")
def _(spark, sf):
    sums = offsets.offset_sums(derive.offsets(spark, sf))
    return _captured(sums, "sum_of_end_offsets", "partitions")


@query(
    "e5_offsets_of_topics",
    OFF + """, asked AS (SELECT DISTINCT 'logs.' || event_type AS topic FROM events
  UNION SELECT DISTINCT 'logs.' || lower(c_mktsegment) FROM customer)
SELECT topic, coalesce(s.sum_of_end_offsets, 0) AS sum_of_end_offsets, coalesce(s.partitions, 0) AS partitions
FROM asked LEFT JOIN (SELECT topic, arg_max(sum_of_end_offsets, snapshot) AS sum_of_end_offsets,
  arg_max(partitions, snapshot) AS partitions FROM sums GROUP BY topic) s USING (topic)""",
)
def _(spark, sf):
    """The latest sums of topics, some of which do not exist."""
    events = derive.table(spark, sf, "events").select(F.concat(F.lit("logs."), "event_type").alias("topic"))
    others = derive.table(spark, sf, "customer").select(
        F.concat(F.lit("logs."), F.lower("c_mktsegment")).alias("topic")
    )
    sums = offsets.offset_sums(derive.offsets(spark, sf))
    latest = sums.groupBy("topic").agg(
        F.max("captured_at").alias("captured_at"),
        F.max_by("sum_of_end_offsets", "captured_at").alias("sum_of_end_offsets"),
        F.max_by("partitions", "captured_at").alias("partitions"),
    )
    return offsets.offsets_of_topics(events.unionByName(others).distinct(), latest)


@query(
    "e8_previous_snapshot",
    OFF + f"SELECT {_SUM}, previous_sum, previous_at * 1000 AS previous_millis FROM rates",
)
def _(spark, sf):
    pairs = offsets.with_previous_snapshot(offsets.offset_sums(derive.offsets(spark, sf)))
    pairs = pairs.withColumn("previous_millis", F.unix_millis("previous_at"))
    return _captured(pairs, "sum_of_end_offsets", "partitions", "previous_sum", "previous_millis")


@query(
    "e8_state_in_force",
    f"""WITH {derive.LOGS}, timed AS (SELECT *, (us - {derive.FIRST_MICROS}) * 1000000 + event_id AS place FROM logs),
changes AS (SELECT service_name, place AS since, value AS level FROM timed WHERE event_id % 13 = 0)
SELECT t.event_id, c.since, c.level FROM timed t ASOF LEFT JOIN changes c
  ON t.service_name = c.service_name AND t.place >= c.since""",
)
def _(spark, sf):
    """Of every event the level that was last set for its service; each thirteenth event sets one."""
    at = (F.col("us") - derive.FIRST_MICROS) * 1_000_000 + F.col("event_id")
    rows = derive.logs(spark, sf).select("event_id", "service_name", "value", at.alias("at"))
    changes = rows.where("event_id % 13 = 0").select("service_name", F.col("at").alias("since"), F.col("value").alias("level"))
    day = 86_400_000_000 * 1_000_000
    joined = adjacent.as_of_join(
        rows, changes, ["service_name"], "at", {"since": "since", "level": "level"}, lambda t: F.floor(t / day), since="since"
    )
    return joined.select("event_id", "since", "level")


_RATE_COLUMNS = ["offset_delta", "elapsed_seconds", "rate", "valid"]


def _rates(spark, sf) -> DataFrame:
    return offsets.offset_rates(offsets.offset_sums(derive.offsets(spark, sf)))


@query(
    "g4_offset_rates",
    OFF + "SELECT topic, snapshot * 1000 AS captured_millis, offset_delta, elapsed_seconds, rate, valid FROM rates",
)
def _(spark, sf):
    return _captured(_rates(spark, sf), *_RATE_COLUMNS)


@query(
    "d12_valid_samples",
    OFF + "SELECT topic, snapshot * 1000 AS captured_millis, rate FROM rates WHERE valid",
)
def _(spark, sf):
    return _captured(offsets.valid_samples(_rates(spark, sf)), "rate")


@query(
    "j5_required_partitions",
    OFF + """SELECT topic, snapshot * 1000 AS captured_millis, rate, partitions,
  CAST(ceil(rate / 2000.0) AS INTEGER) AS required_partitions
FROM rates WHERE valid AND ceil(rate / 2000.0) > partitions""",
)
def _(spark, sf):
    decisions = partition_sizing.recommend_partitions(derive.offsets(spark, sf))
    return _captured(decisions, "rate", "partitions", "required_partitions")


@query(
    "j9_elapsed_seconds",
    G + """SELECT run_id, records_read, submission_time,
  CAST(trunc((completion_time - submission_time) / 1000) AS BIGINT) AS seconds FROM stages""",
)
def _(spark, sf):
    seconds = timefmt.elapsed_seconds(F.col("submission_time"), F.col("completion_time"))
    return derive.stage_events(spark, sf).select(
        "run_id", "records_read", "submission_time", seconds.alias("seconds")
    )


@query(
    "m3_consumer_lag",
    OFF + """, latest AS (SELECT topic, "partition", max(end_offset) AS end_offset FROM offsets GROUP BY 1, 2),
committed AS (SELECT topic, "partition", max(end_offset) AS committed_offset FROM offsets
  WHERE snapshot < 1704068400 AND NOT (topic = 'logs.view' AND "partition" = 1) GROUP BY 1, 2)
SELECT topic, CAST(sum(end_offset - coalesce(committed_offset, 0)) AS BIGINT) AS lag,
  CAST(count(*) AS INTEGER) AS partitions,
  CAST(sum(end_offset - coalesce(committed_offset, 0)) // count(*) AS BIGINT) AS lag_per_partition
FROM latest LEFT JOIN committed USING (topic, "partition") GROUP BY topic""",
)
def _(spark, sf):
    rows = derive.offsets(spark, sf)
    latest = rows.groupBy("topic", "partition").agg(F.max("end_offset").alias("end_offset"))
    committed = (
        rows.where(F.unix_seconds("captured_at") < 1704068400)
        .where("NOT (topic = 'logs.view' AND partition = 1)")
        .groupBy("topic", "partition")
        .agg(F.max("end_offset").alias("committed_offset"))
    )
    return offsets.consumer_lag(latest, committed)


# Sizing


@query(
    "j1_admission_size",
    R + "SELECT tenant, submission_time, CASE WHEN cores_used < 40 THEN 750000000 ELSE "
    "least(3500000000, greatest(500000000, CAST(cores_used AS BIGINT) * 30 * 900000 + 200000000)) END "
    "AS records FROM runs",
)
def _(spark, sf):
    cores = F.when(F.col("cores_used") >= 40, F.col("cores_used") * 30)
    return derive.runs(spark, sf).select(
        "tenant", "submission_time", sizing.admission_size(cores).alias("records")
    )


_SIZED = f"""WITH {derive.SERIES}, {derive.TENANTS},
log_numbers AS (SELECT tenant, count(*) - 1 AS number, (count(*) - 1) % 10 = 9 AS compacted
  FROM runs GROUP BY tenant),
sized AS (
  SELECT f.tenant, number, compacted, max_records, n_runs,
    CASE WHEN rising AND newest_is_largest THEN greatest(0, growth) ELSE 0 END
      + CASE WHEN number % 10 >= 7 THEN 0.5 ELSE 0 END AS buffer_share
  FROM facts f JOIN log_numbers USING (tenant)),
expected AS (
  SELECT tenant, number, compacted, max_records, buffer_share,
    CASE WHEN n_runs >= 5 THEN CAST(ceil(ceil((max_records + CAST(ceil(buffer_share * max_records) AS BIGINT))
      / 20000.0) / 2.0) AS INTEGER) END AS expected
  FROM sized)"""
# Fewer records per core than the default, so that the given tables call for several workers.
_PER_CORE = 20_000


@query(
    "j2_required_workers",
    _SIZED + " SELECT tenant, max_records, round(buffer_share, 6) AS buffer_share, expected FROM expected",
)
def _(spark, sf):
    expected = worker_sizing.expected_workers(
        derive.runs(spark, sf), _log_numbers(spark, sf), per_core=_PER_CORE
    )
    return expected.select(
        "tenant", "max_records", F.round("buffer_share", 6).alias("buffer_share"), "expected"
    )


@query(
    "j3_compaction_buffer",
    f"WITH {derive.SINK_LOGS} SELECT tenant, number, CAST(CASE WHEN number % 10 >= 7 THEN 0.5 ELSE 0 END "
    "AS DOUBLE) AS buffer, number % 10 <> 8 AS may_shrink FROM sink_logs",
)
def _(spark, sf):
    files = maintenance.sink_log_files(derive.sink_logs(spark, sf))
    number = F.col("number")
    return files.select(
        "tenant",
        "number",
        sizing.compaction_buffer(number).alias("buffer"),
        sizing.allows_downscale(number).alias("may_shrink"),
    )


@query(
    "e6_switches",
    T + "SELECT tenant, upscale, downscale FROM switches",
)
def _(spark, sf):
    return worker_sizing.resolve_switches(derive.requests(spark, sf), derive.overrides(spark, sf))


@query(
    "e7_combined_inputs",
    _SIZED + " SELECT tenant, number, compacted, expected, actual FROM expected JOIN actual USING (tenant)",
)
def _(spark, sf):
    expected = worker_sizing.expected_workers(
        derive.runs(spark, sf), _log_numbers(spark, sf), per_core=_PER_CORE
    )
    return expected.join(derive.actual_workers(spark, sf), "tenant").select(
        "tenant", "number", "compacted", "expected", "actual"
    )


_DECISION = """, inputs AS (
  SELECT *, least(10, greatest(2, expected)) AS bounded, downscale AND number % 10 <> 8 AS may_shrink
  FROM expected JOIN actual USING (tenant) JOIN switches USING (tenant)),
decided AS (SELECT *, CASE
  WHEN NOT (upscale OR downscale) THEN 'off' WHEN compacted THEN 'compacted'
  WHEN expected IS NULL OR expected = 0 OR actual = 0 THEN 'no data' WHEN bounded = actual THEN 'same'
  WHEN actual - bounded >= 2 AND may_shrink THEN 'down' WHEN bounded - actual >= 1 AND upscale THEN 'up'
  ELSE 'ignored' END AS what FROM inputs)
SELECT tenant, actual, expected, CASE WHEN what IN ('up', 'down') THEN what ELSE 'none' END AS action,
  CAST(CASE what WHEN 'down' THEN actual - CASE WHEN 1 - bounded / actual >= 0.25
      THEN least(50, ceil(actual * 0.25)) ELSE least(50, actual - bounded) END
    WHEN 'up' THEN actual + least(200, bounded - actual) ELSE actual END AS INTEGER) AS target,
  CASE what WHEN 'off' THEN 'scaling is switched off' WHEN 'compacted' THEN 'latest sink log is compacted'
    WHEN 'no data' THEN 'not enough data' WHEN 'same' THEN 'already at the expected size'
    WHEN 'down' THEN 'too many workers' WHEN 'up' THEN 'too few workers'
    ELSE 'disabled or step too small' END AS reason
FROM decided"""


@query("j4_scale_decision", _SIZED + _DECISION)
def _(spark, sf):
    return worker_sizing.recommend_workers(
        derive.runs(spark, sf),
        _log_numbers(spark, sf),
        derive.actual_workers(spark, sf),
        derive.requests(spark, sf),
        derive.overrides(spark, sf),
        per_core=_PER_CORE,
    )
