"""Log-shaped tables derived from the given ones, and the same tables as SQL."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import keys, timefmt
from tidelog.session import work_folder
from tidelog.sinks import logs as log_sink
from tidelog.sources import tiers, wire
from tidelog.streaming import ingest

TENANT = "ABC"
# The clock of the freshness queries, shortly after the last event and after midnight.
NOW_SECONDS = 1706659800
FIRST_MICROS = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _logs(spark: SparkSession, sf_dir: str, micros: Column) -> DataFrame:
    seconds = timefmt.int_div(F.col("us"), 1_000_000)
    nanos = F.pmod(F.col("us"), F.lit(1_000_000)) * 1000
    return (
        table(spark, sf_dir, "events")
        .withColumn("us", micros)
        .select(
            "event_id",
            "event_type",
            "user_id",
            "value",
            "props",
            "us",
            F.concat(F.lit("svc-"), "event_type").alias("service_name"),
            timefmt.iso_instant(seconds, nanos).alias("timestamp"),
            F.concat_ws(" ", "event_type", F.concat(F.lit("user="), "user_id"), "props").alias("message"),
            F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")).alias("hostname"),
            timefmt.partition_time(seconds).alias("time"),
        )
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows."""
    return _logs(spark, sf_dir, _micros("ts"))


def dense_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a faster clock: a day of events is a minute of logs."""
    since = _micros("ts") - FIRST_MICROS
    return _logs(spark, sf_dir, F.lit(FIRST_MICROS) + timefmt.int_div(since, 1440))


_LOG_SQL = """{name} AS (
  SELECT event_id, event_type, user_id, value, props, us,
    'svc-' || event_type AS service_name,
    strftime(moment, '%Y-%m-%dT%H:%M:%S') || CASE
      WHEN us % 1000000 = 0 THEN ''
      WHEN us % 1000 = 0 THEN '.' || lpad(CAST((us % 1000000) // 1000 AS VARCHAR), 3, '0')
      ELSE '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS "timestamp",
    event_type || ' user=' || user_id || ' ' || props AS message,
    'host-' || (user_id % 10) AS hostname,
    strftime(moment, 'year=%Y/month=%m/day=%d/hour=%H/minute=%M') AS time,
    moment
  FROM (SELECT *, make_timestamp(us) AS moment FROM (SELECT *, {micros} AS us FROM events)))"""
LOGS = _LOG_SQL.format(name="logs", micros="epoch_us(ts)")
DENSE = _LOG_SQL.format(
    name="dense", micros=f"{FIRST_MICROS} + (epoch_us(ts) - {FIRST_MICROS}) // 1440"
)

_stored: dict[tuple, str] = {}


def once(spark: SparkSession, sf_dir: str, purpose: str, write) -> str:
    """Writes a derived table once per session, so that queries can share it."""
    key = (spark.sparkContext.applicationId, sf_dir, purpose)
    if key not in _stored:
        root = work_folder(spark, purpose)
        write(root)
        _stored[key] = root
    return _stored[key]


def stored_logs(spark: SparkSession, sf_dir: str) -> str:
    """Root of the partitioned log table of the dense logs."""

    def write(root: str) -> None:
        rows = dense_logs(spark, sf_dir).select("message", "timestamp", "service_name", "hostname")
        log_sink.write_logs(log_sink.with_time_partitions(rows), root)

    return once(spark, sf_dir, "logs", write)


# Minute at which the tiers of `tiered_logs` meet.
HANDOVER = datetime(2024, 1, 1, 0, 12)


def tiered_logs(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Roots of a stream's table of the dense logs and of its closed tier.

    The stream stores three parts: rows before the handover, which are then closed; later ones; and late
    rows of closed minutes. A file of a batch that failed lies beside the committed ones.
    """

    def write(root: str) -> None:
        rows = dense_logs(spark, sf_dir).select("message", "timestamp", "service_name", "hostname", "us", "event_id")
        before = F.col("us") < F.lit(FIRST_MICROS + 12 * 60_000_000)
        late = before & (F.col("event_id") % 10 == 0)
        for number, part in enumerate((before & ~late, ~before, late)):
            columns = log_sink.with_time_partitions(rows.where(part)).drop("us", "event_id")
            columns.write.mode("append").parquet(f"{root}/source")
            stream = spark.readStream.schema(columns.schema).parquet(f"{root}/source")
            ingest.start_sink(stream, f"{root}/table", f"{root}/checkpoint", "tiers", trigger_seconds=None).awaitTermination()
            if number == 0:
                tiers.close_until(spark, f"{root}/table", f"{root}/closed", HANDOVER)
        lost = rows.limit(1000).withColumn("message", F.lit("click of a failed batch"))
        log_sink.write_logs(log_sink.with_time_partitions(lost).drop("us", "event_id"), f"{root}/lost")
        # As a failed batch leaves it: files among the others that the sink's log does not know.
        spread = spark.read.schema(model.TABLE_SCHEMA).parquet(f"{root}/lost")
        spread.write.mode("append").partitionBy(*model.PARTITION_COLUMNS).parquet(f"{root}/table")

    root = once(spark, sf_dir, "tiers", write)
    return f"{root}/table", f"{root}/closed"


def wire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense logs as record bytes: values below 1 are cut short, below 2 have no timestamp."""
    rows = dense_logs(spark, sf_dir)
    us = F.when((F.col("value") >= 1) & (F.col("value") < 2), F.lit(None)).otherwise(F.col("us"))
    rows = wire.encode_records(
        rows,
        F.col("service_name"),
        F.col("message"),
        F.col("event_type"),
        timefmt.int_div(us, 1_000_000),
        F.pmod(us, F.lit(1_000_000)) * 1000,
        value="value_bytes",
    )
    cut = F.substring(F.col("value_bytes"), F.lit(1), F.octet_length("value_bytes") - 1)
    return rows.select(
        "event_id",
        "us",
        F.when(F.col("value") < 1, cut).otherwise(F.col("value_bytes")).alias("value"),
    )


def wire_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of record files, in eight parts by time."""
    return once(
        spark,
        sf_dir,
        "wire",
        lambda root: wire_rows(spark, sf_dir)
        .repartitionByRange(8, "us")
        .select("value")
        .write.parquet(root),
    )


def _varint_hex(n: str) -> str:
    """SQL of the base-128 bytes of a number below 2**35, as hex digits."""
    cases = []
    for length in range(1, 6):
        bytes_ = [f"({n}) // {128**i} % 128 + {0 if i == length - 1 else 128}" for i in range(length)]
        cases.append(f"WHEN ({n}) < {128**length} THEN printf('{'%02x' * length}', {', '.join(bytes_)})")
    return f"CASE {' '.join(cases)} END"


def _text_hex(key: str, text: str) -> str:
    return f"'{key}' || {_varint_hex(f'octet_length(encode({text}))')} || hex(encode({text}))"


_SECONDS, _NANOS = "us // 1000000", "us % 1000000 * 1000"
_CLOCK_HEX = (
    f"'08' || {_varint_hex(_SECONDS)} || CASE WHEN {_NANOS} = 0 THEN '' ELSE '10' || {_varint_hex(_NANOS)} END"
)
# A record's bytes without the last one.
_CUT_RECORD = (
    f"unhex(left(record, length(record) - 2)) FROM (SELECT {_text_hex('0a', 'service_name')} || "
    f"{_text_hex('12', 'message')} || {_text_hex('1a', 'event_type')} || '22' || "
    f"{_varint_hex('length(clock) // 2')} || clock AS record FROM (SELECT {_CLOCK_HEX} AS clock))"
)

# Log rows as the ingest stream stores them; dead letters lie at the time of ingest.
INGESTED = (
    DENSE
    + """, ingested AS (
  SELECT event_id,
    CASE WHEN value < 1 THEN '__dead_letter__' ELSE service_name END AS service_name,
    CASE WHEN value < 1 THEN to_base64((SELECT {cut})) ELSE message END AS message,
    CASE WHEN value < 1 THEN NULL WHEN value < 2 THEN '1970-01-01T00:00:00Z' ELSE "timestamp" END AS "timestamp",
    CASE WHEN value < 1 THEN NULL WHEN value < 2 THEN 'year=1970/month=01/day=01/hour=00/minute=00' ELSE time END AS time
  FROM dense)""".replace("{cut}", _CUT_RECORD)
)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object key per event."""
    rows = logs(spark, sf_dir)
    directory = keys.partition_path(
        F.col("service_name"), timefmt.int_div(F.col("us"), 1_000_000)
    )
    return rows.select(
        F.concat(F.lit("logs/"), directory, F.lit("/part-"), "event_id").alias("path"),
        (F.length("message") * 1000).cast("bigint").alias("length"),
        F.timestamp_micros("us").alias("modification_time"),
    )


OBJECTS = (
    LOGS
    + """, objects AS (
  SELECT 'logs/service_name=' || service_name || '/' || time || '/part-' || event_id AS path,
    CAST(length(message) * 1000 AS BIGINT) AS length, service_name, us, moment FROM logs)"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents; a document is a file."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_path"),
        F.lit(0).alias("block"),
        F.posexplode(F.split("text", "\n")).alias("row", "value"),
    )


LINES = """lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def _days_after(date: str, days: Column) -> Column:
    return F.date_add(F.lit(date).cast("date"), days.cast("int")).cast("timestamp")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tenants' services; some are stored, some are not."""
    days = F.col("s_nationkey")
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(
        F.concat(F.lit("svc-supplier-"), "s_suppkey").alias("service_name"),
        (days + 1).cast("int").alias("retention_days"),
        F.lit(TENANT).alias("tenant"),
        _days_after("2024-01-01", days).alias("last_checked_at"),
    )
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("svc-"), F.lower("n_name")).alias("service_name"),
        (F.col("n_regionkey") + 3).cast("int").alias("retention_days"),
        F.lit(TENANT).alias("tenant"),
        _days_after("2024-01-20", F.lit(0)).alias("last_checked_at"),
    )
    types = table(spark, sf_dir, "events").where("length(event_type) <= 5").select(
        F.concat(F.lit("svc-"), "event_type").alias("service_name"),
        F.lit(7).alias("retention_days"),
        F.lit(TENANT).alias("tenant"),
        _days_after("2024-01-25", F.lit(0)).alias("last_checked_at"),
    )
    other = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("svc-"), F.lower("c_mktsegment")).alias("service_name"),
        F.lit(30).alias("retention_days"),
        F.lit("XYZ").alias("tenant"),
        _days_after("2024-01-02", F.lit(0)).alias("last_checked_at"),
    )
    return (
        suppliers.unionByName(nations).unionByName(types.distinct()).unionByName(other.distinct())
    )


def found_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of services that have data."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("svc-"), "event_type").alias("service_name")
    )
    shipped = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("svc-supplier-"), "l_suppkey").alias("service_name")
    )
    return events.unionByName(shipped).distinct()


CATALOG = """catalog AS (
  SELECT 'svc-supplier-' || s_suppkey AS service_name,
    CAST(s_nationkey + 1 AS INTEGER) AS retention_days, 'ABC' AS tenant,
    DATE '2024-01-01' + CAST(s_nationkey AS INTEGER) AS checked
  FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 'svc-' || lower(n_name), CAST(n_regionkey + 3 AS INTEGER), 'ABC',
    DATE '2024-01-20' FROM nation
  UNION ALL SELECT DISTINCT 'svc-' || event_type, 7, 'ABC', DATE '2024-01-25'
    FROM events WHERE length(event_type) <= 5
  UNION ALL SELECT DISTINCT 'svc-' || lower(c_mktsegment), 30, 'XYZ', DATE '2024-01-02'
    FROM customer),
found AS (
  SELECT DISTINCT 'svc-' || event_type AS service_name FROM events
  UNION SELECT DISTINCT 'svc-supplier-' || l_suppkey FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per tenant and day from the orders of that day."""
    submitted = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("tenant"),
            submitted.alias("submission_time"),
        )
        .agg(
            F.sum(F.col("o_custkey") % 1000 + 200_000).cast("bigint").alias("input_records"),
            F.sum(F.floor("o_totalprice")).cast("bigint").alias("output_bytes"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(
            "output_bytes",
            "input_records",
            "submission_time",
            (F.col("submission_time") + F.col("_n") * 1000).alias("completion_time"),
            (F.col("_n") * 37).cast("int").alias("cores_used"),
            F.lit("succeeded").alias("status"),
            "tenant",
            F.timestamp_millis(F.col("submission_time") + 60_000).alias("created_at"),
        )
    )


RUNS = """runs AS (
  SELECT CAST(sum(floor(o_totalprice)) AS BIGINT) AS output_bytes,
    CAST(sum(o_custkey % 1000 + 200000) AS BIGINT) AS input_records,
    epoch_ms(o_orderdate) AS submission_time,
    epoch_ms(o_orderdate) + count(*) * 1000 AS completion_time,
    CAST(count(*) * 37 AS INTEGER) AS cores_used, 'succeeded' AS status,
    o_orderpriority || '-' || o_orderstatus AS tenant
  FROM orders GROUP BY o_orderdate, o_orderpriority || '-' || o_orderstatus)"""

_LAST_RUN = """last5 AS (
  SELECT tenant, input_records,
    row_number() OVER (PARTITION BY tenant ORDER BY submission_time DESC) AS n FROM runs),
series AS (
  SELECT tenant, count(*) AS n_runs, max(input_records) AS max_records,
    max(CASE WHEN n = 1 THEN input_records END) AS x1,
    max(CASE WHEN n = 2 THEN input_records END) AS x2,
    max(CASE WHEN n = 3 THEN input_records END) AS x3,
    max(CASE WHEN n = 4 THEN input_records END) AS x4,
    max(CASE WHEN n = 5 THEN input_records END) AS x5
  FROM last5 WHERE n <= 5 GROUP BY tenant),
facts AS (
  SELECT *,
    coalesce(x1 >= x2, true) AND coalesce(x2 >= x3, true) AND coalesce(x3 >= x4, true) AS rising,
    x1 = max_records AS newest_is_largest,
    coalesce((coalesce(CAST(x1 - x2 AS DOUBLE) / x2, 0) + coalesce(CAST(x2 - x3 AS DOUBLE) / x3, 0)
      + coalesce(CAST(x3 - x4 AS DOUBLE) / x4, 0) + coalesce(CAST(x4 - x5 AS DOUBLE) / x5, 0))
      / nullif(n_runs - 1, 0), 0) AS growth
  FROM series)"""
SERIES = RUNS + ", " + _LAST_RUN


def sink_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's file in its tenant's sink log; every tenth is a compacted one."""
    order = Window.partitionBy("tenant").orderBy("submission_time")
    number = (F.row_number().over(order) - 1).alias("number")
    name = F.concat(
        F.col("number").cast("string"),
        F.when(F.col("number") % 10 == 9, F.lit(".compact")).otherwise(F.lit("")),
    )
    return (
        runs(spark, sf_dir)
        .select("tenant", number, "output_bytes", "created_at")
        .select(
            "tenant",
            F.concat(F.lit("logs/"), "tenant", F.lit("/_spark_metadata/"), name).alias("path"),
            F.col("output_bytes").alias("length"),
            F.col("created_at").alias("modification_time"),
        )
    )


SINK_LOGS = (
    RUNS
    + """, sink_logs AS (
  SELECT tenant, number, number || CASE WHEN number % 10 = 9 THEN '.compact' ELSE '' END AS name
  FROM (SELECT tenant,
    row_number() OVER (PARTITION BY tenant ORDER BY submission_time) - 1 AS number FROM runs))"""
)


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tenant with the number of its orders, from which switches and workers follow."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("tenant"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def _three_way(column: str) -> Column:
    value = F.when(F.col(column) % 3 == 1, True).when(F.col(column) % 3 == 2, False)
    return value.otherwise(F.lit(None).cast("boolean"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tenants(spark, sf_dir).where(~F.col("tenant").endswith("-O"))
    return rows.select(
        "tenant",
        _three_way("orders").alias("upscale"),
        F.lit(None).cast("boolean").alias("downscale"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenants(spark, sf_dir).select(
        "tenant",
        (F.col("orders") % 5 != 0).alias("upscale"),
        (F.col("orders") % 4 != 0).alias("downscale"),
    )


def actual_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenants(spark, sf_dir).select("tenant", (F.col("orders") % 15).cast("int").alias("actual"))


TENANTS = """tenants AS (
  SELECT o_orderpriority || '-' || o_orderstatus AS tenant, count(*) AS orders
  FROM orders GROUP BY 1),
overrides AS (
  SELECT tenant, CASE WHEN orders % 3 = 1 THEN true WHEN orders % 3 = 2 THEN false END AS upscale,
    CAST(NULL AS BOOLEAN) AS downscale FROM tenants WHERE tenant NOT LIKE '%-O'),
requests AS (
  SELECT tenant, orders % 5 <> 0 AS upscale, orders % 4 <> 0 AS downscale FROM tenants),
switches AS (
  SELECT r.tenant, coalesce(o.upscale, r.upscale) AS upscale,
    coalesce(o.downscale, r.downscale) AS downscale
  FROM requests r LEFT JOIN overrides o USING (tenant)),
actual AS (SELECT tenant, CAST(orders % 15 AS INTEGER) AS actual FROM tenants)"""


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative offsets of three partitions per topic, a snapshot a day on the fast clock.

    Most snapshots are a minute apart; some are too close and some too far.
    """
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day")
    counted = (
        table(spark, sf_dir, "events")
        .groupBy(
            F.concat(F.lit("logs."), "event_type").alias("topic"),
            (F.col("user_id") % 3).cast("int").alias("partition"),
            day,
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    so_far = Window.partitionBy("topic", "partition").orderBy("day")
    seconds = (
        F.lit(1704067200)
        + F.col("day") * 60
        + F.when(F.col("day") % 7 == 0, 45).otherwise(0)
        + timefmt.int_div(F.col("day"), 10) * 600
    )
    return counted.select(
        "topic",
        "partition",
        (F.sum("n").over(so_far) * 10_000).alias("end_offset"),
        F.timestamp_seconds(seconds).alias("captured_at"),
    )


OFFSETS = """offsets AS (
  SELECT topic, "partition", CAST(sum(n) OVER (PARTITION BY topic, "partition" ORDER BY day) AS BIGINT)
      * 10000 AS end_offset,
    1704067200 + day * 60 + CASE WHEN day % 7 = 0 THEN 45 ELSE 0 END + (day // 10) * 600 AS snapshot
  FROM (
    SELECT 'logs.' || event_type AS topic, CAST(user_id % 3 AS INTEGER) AS "partition",
      date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, count(*) AS n
    FROM events GROUP BY 1, 2, 3)),
sums AS (
  SELECT topic, snapshot, CAST(sum(end_offset) AS BIGINT) AS sum_of_end_offsets,
    CAST(count(*) AS INTEGER) AS partitions
  FROM offsets GROUP BY topic, snapshot),
rates AS (
  SELECT *, sum_of_end_offsets - previous_sum AS offset_delta, snapshot - previous_at AS elapsed_seconds,
    CAST(trunc((sum_of_end_offsets - previous_sum) // nullif(snapshot - previous_at, 0)) AS BIGINT) AS rate,
    coalesce(snapshot - previous_at > 30 AND snapshot - previous_at <= 300, false) AS valid
  FROM (SELECT *, lag(sum_of_end_offsets) OVER w AS previous_sum, lag(snapshot) OVER w AS previous_at
    FROM sums WINDOW w AS (PARTITION BY topic ORDER BY snapshot)))"""


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage event per order line."""
    shipped = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("stage-"), "l_returnflag").alias("stage_name"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("submitted").alias("event"),
        F.when(F.col("l_discount") > 0.08, "failed").otherwise("succeeded").alias("status"),
        F.col("l_quantity").cast("bigint").alias("records_read"),
        F.floor("l_extendedprice").alias("bytes_written"),
        F.when(F.col("l_linenumber") != 2, shipped).alias("submission_time"),
        (shipped + F.col("l_quantity").cast("bigint") * 1000).alias("completion_time"),
    )


STAGES = """stages AS (
  SELECT l_orderkey AS run_id, 'stage-' || l_returnflag AS stage_name,
    CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'submitted' END AS event,
    CASE WHEN l_discount > 0.08 THEN 'failed' ELSE 'succeeded' END AS status,
    CAST(l_quantity AS BIGINT) AS records_read, CAST(floor(l_extendedprice) AS BIGINT) AS bytes_written,
    CASE WHEN l_linenumber <> 2 THEN epoch_ms(l_shipdate) END AS submission_time,
    epoch_ms(l_shipdate) + CAST(l_quantity AS BIGINT) * 1000 AS completion_time
  FROM lineitem)"""
