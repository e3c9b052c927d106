"""Queries over log rows: sources, sinks, transforms, predicates and search."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import keys, patterns, timefmt
from tidelog.operators import multiline, predicates, shaping
from tidelog.plans import collect, search
from tidelog.session import work_folder
from tidelog.sinks import logs as log_sink
from tidelog.sources import files, listing, tables, tiers, wire
from workload import derive
from workload.registry import query

L, D = f"WITH {derive.LOGS} ", f"WITH {derive.DENSE} "
START, END = datetime(2024, 1, 5, 6, 30), datetime(2024, 1, 20, 18, 45)
DENSE_START, DENSE_END = datetime(2024, 1, 1, 0, 4), datetime(2024, 1, 1, 0, 21)
_IN_RANGE = (
    "time BETWEEN 'year=2024/month=01/day=05/hour=06/minute=30' "
    "AND 'year=2024/month=01/day=20/hour=18/minute=45'"
)
_IN_DENSE_RANGE = (
    "time BETWEEN 'year=2024/month=01/day=01/hour=00/minute=04' "
    "AND 'year=2024/month=01/day=01/hour=00/minute=21'"
)
_PARTS = (
    "CAST(strftime(moment, '%Y') AS INTEGER) AS year, strftime(moment, '%m') AS month, "
    "strftime(moment, '%d') AS day, strftime(moment, '%H') AS hour, strftime(moment, '%M') AS minute"
)
_TEXT_PARTS = _PARTS.replace("CAST(strftime(moment, '%Y') AS INTEGER)", "strftime(moment, '%Y')")


# Sources


@query(
    "a3_replay_stored",
    D + "SELECT service_name, message, \"timestamp\" FROM dense WHERE us >= epoch_us(TIMESTAMP '2024-01-01 00:10:00.5')",
)
def _(spark, sf):
    """From the stored table, with an offset; partitions before it are not read."""
    logs = tables.read_logs(spark, derive.stored_logs(spark, sf))
    return tables.replay_from(logs, "2024-01-01T02:10:00.5+02:00").select("service_name", "message", "timestamp")


@query(
    "a3_replay_from",
    L + "SELECT event_id, service_name, \"timestamp\" FROM logs "
    "WHERE us >= epoch_us(TIMESTAMP '2024-01-12 08:00:00')",
)
def _(spark, sf):
    rows = tables.replay_from(derive.logs(spark, sf), "2024-01-12T08:00:00Z")
    return rows.select("event_id", "service_name", "timestamp")


@query(
    "a5_log_table_scan",
    D + "SELECT service_name, time, count(*) AS n, min(\"timestamp\") AS first_at, "
    "max(\"timestamp\") AS last_at, count(hostname) AS hosts, CAST(0 AS BIGINT) AS source_types "
    "FROM dense GROUP BY service_name, time",
)
def _(spark, sf):
    stored = tables.read_logs(spark, derive.stored_logs(spark, sf))
    return stored.groupBy("service_name", "time").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
        F.count("hostname").alias("hosts"),
        F.count("source_type").alias("source_types"),
    )


@query(
    "a6_projected_scan",
    D + "SELECT service_name, time, \"timestamp\", message FROM dense "
    f"WHERE service_name IN ('svc-error', 'svc-click', 'svc-none') AND {_IN_DENSE_RANGE}",
)
def _(spark, sf):
    rows = tables.read_logs_projected(
        spark,
        derive.stored_logs(spark, sf),
        ["svc-error", "svc-click", "svc-none"],
        DENSE_START,
        DENSE_END,
    )
    return rows.select("service_name", "time", "timestamp", "message")


@query(
    "a7_object_listing",
    D + "SELECT 'service_name=' || service_name || '/' AS prefix, "
    "count(DISTINCT time) AS directories FROM dense GROUP BY service_name",
)
def _(spark, sf):
    root = derive.stored_logs(spark, sf)
    return (
        listing.list_objects(spark, root, "service_name=")
        .groupBy(keys.common_prefix(F.col("path"), "service_name=").alias("prefix"))
        .agg(F.count_distinct(keys.minute_from_key(F.col("path"))).alias("directories"))
    )


@query(
    "a7_common_prefixes",
    "SELECT DISTINCT regexp_extract(url, '^(http://[^/]*/)', 1) AS prefix FROM pages "
    "WHERE regexp_matches(url, '^http://[^/]*/')",
)
def _(spark, sf):
    urls = derive.table(spark, sf, "pages").select(F.col("url").alias("path"))
    return listing.list_common_prefixes(urls, "http://")


_TEXT_FILES = f"""WITH {derive.LINES}
SELECT lang, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars,
  count(DISTINCT line) AS distinct_lines
FROM lines JOIN documents USING (doc_id) GROUP BY lang"""


def _text_folder(spark, sf, compression: str) -> str:
    return derive.once(
        spark,
        sf,
        f"text-{compression}",
        lambda root: derive.table(spark, sf, "documents")
        .select("lang", F.col("text").alias("value"))
        .write.partitionBy("lang")
        .option("compression", compression)
        .text(root),
    )


def _line_summary(lines: DataFrame) -> DataFrame:
    lang = F.regexp_extract("file_path", "lang=([a-z]+)/", 1).alias("lang")
    return lines.groupBy(lang).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length("value")).alias("chars"),
        F.count_distinct("value").alias("distinct_lines"),
    )


@query("a9_text_files", _TEXT_FILES)
def _(spark, sf):
    root = _text_folder(spark, sf, "none")
    return _line_summary(files.read_text_lines(spark, root, line_separator="\n"))


@query("a9_gzip_text_files", _TEXT_FILES)
def _(spark, sf):
    root = _text_folder(spark, sf, "gzip")
    return _line_summary(files.read_text_lines(spark, f"{root}/*/*.gz", line_separator="\n"))


@query(
    "a9_line_numbers",
    f"""WITH {derive.LINES}, counted AS (SELECT lang, count(*) AS n FROM lines
  JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS numbers FROM counted""",
)
def _(spark, sf):
    numbered = files.number_lines(
        files.read_text_lines(spark, _text_folder(spark, sf, "none"), line_separator="\n")
    )
    per_file = numbered.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("line_no").alias("numbers")
    )
    lang = F.regexp_extract("file_path", "lang=([a-z]+)/", 1).alias("lang")
    return per_file.groupBy(lang).agg(F.sum("n").alias("n_lines"), F.sum("numbers").alias("numbers"))


@query(
    "a10_json_lines",
    "SELECT CASE WHEN value >= 3 THEN CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) "
    "END AS k, CASE WHEN value < 3 THEN left(props, length(props) - 1) END AS corrupt_record FROM events",
)
def _(spark, sf):
    """Files of lines, of which those of small values are cut short, so that some are no JSON."""
    cut = F.substring(F.col("props"), F.lit(1), F.length("props") - 1)
    lines = derive.table(spark, sf, "events").select(
        F.when(F.col("value") < 3, cut).otherwise(F.col("props")).alias("value")
    )
    root = derive.once(spark, sf, "json-lines", lambda folder: lines.repartition(4).write.text(folder))
    return files.read_json_lines(spark, root, model.schema_of("k bigint")).select("k", "corrupt_record")


@query(
    "a11_raw_lines",
    f"WITH {derive.LINES} SELECT lang, line AS message FROM lines JOIN documents USING (doc_id)",
)
def _(spark, sf):
    lines = files.read_raw_lines(spark, _text_folder(spark, sf, "none"), line_separator="\n")
    return lines.select(F.regexp_extract("file_path", "lang=([a-z]+)/", 1).alias("lang"), "message")


@query(
    "a9_text_to_table",
    L + """SELECT 'files' AS service_name, message, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
  strftime(moment, 'year=%Y/month=%m/day=%d') AS day FROM logs""",
)
def _(spark, sf):
    """Text files, parsed and stored in the partitioned table."""
    at = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss")
    lines = derive.logs(spark, sf).select(F.concat(at, F.lit(" - "), "message").alias("value"))
    source = derive.once(spark, sf, "timed-lines", lambda folder: lines.repartition(4).write.text(folder))
    pattern = r"^(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - (?P<message>.*)$"
    rows = collect.line_rows(files.read_text_lines(spark, source), pattern, "files")

    # The table has a folder per service and day here: the events are spread over a month.
    def write(root):
        columns = ["service_name", "year", "month", "day"]
        log_sink.write_logs(log_sink.with_time_partitions(rows).drop("hour", "minute"), root, columns)

    root = derive.once(spark, sf, "text-table", write)
    day = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), c) for c in ("year", "month", "day")])
    return spark.read.parquet(root).select("service_name", "message", "timestamp", day.alias("day"))


# Priorities end at 191.
_SEVERITY = "['emerg','alert','crit','err','warning','notice','info','debug'][user_id % 192 % 8 + 1]"


@query(
    "a12_syslog_lines",
    L + f"""SELECT
  CASE WHEN kind <> 'raw' THEN CAST(user_id % 192 // 8 AS INTEGER) END AS facility,
  CASE WHEN kind <> 'raw' THEN {_SEVERITY} END AS severity,
  CASE kind WHEN 'ietf' THEN "timestamp" WHEN 'bsd' THEN strftime(moment, '%b %d %H:%M:%S') END AS syslog_time,
  CASE WHEN kind <> 'raw' THEN hostname END AS hostname,
  CASE WHEN kind <> 'raw' THEN event_type END AS app_name,
  CASE WHEN kind <> 'raw' THEN CAST(event_id AS VARCHAR) END AS process_id,
  CASE WHEN kind = 'ietf' THEN 'ID' || user_id END AS message_id,
  CASE WHEN kind = 'ietf' AND user_id % 2 = 0 THEN '[meta@1 seq="' || event_id || '" note="a] \\"b\\""]' END AS structured_data,
  event_id % 97 = 0 AS oversized, long_message AS message, kind <> 'raw' AS parsed
FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN message || repeat('x', 102400) ELSE message END AS long_message,
  CASE event_type WHEN 'view' THEN 'ietf' WHEN 'click' THEN 'ietf'
  WHEN 'error' THEN 'bsd' ELSE 'raw' END AS kind FROM logs)""",
)
def _(spark, sf):
    """Lines of a text file; some are longer than a receiver's buffer, some have structured data."""
    rows = derive.logs(spark, sf)
    padding = F.when(F.col("event_id") % 97 == 0, F.repeat(F.lit("x"), 102_400)).otherwise("")
    rows = rows.withColumn("message", F.concat("message", padding))
    priority = F.concat(F.lit("<"), F.col("user_id") % 192, F.lit(">"))
    data = F.concat(F.lit('[meta@1 seq="'), "event_id", F.lit('" note="a] \\"b\\""]'))
    ietf = F.concat(
        priority,
        F.concat_ws(
            " ",
            F.lit("1"),
            "timestamp",
            "hostname",
            "event_type",
            "event_id",
            F.concat(F.lit("ID"), "user_id"),
            F.when(F.col("user_id") % 2 == 0, data).otherwise("-"),
            "message",
        ),
    )
    bsd_time = F.date_format(F.timestamp_micros("us"), "MMM dd HH:mm:ss")
    bsd = F.concat(
        priority, bsd_time, F.lit(" "), "hostname", F.lit(" "), "event_type", F.lit("["), "event_id", F.lit("]: "), "message"
    )
    kind = F.col("event_type")
    line = F.when(kind.isin("view", "click"), ietf).when(kind == "error", bsd).otherwise(F.col("message"))
    lines = rows.select(line.alias("value")).repartition(4)
    root = derive.once(spark, sf, "syslog-lines", lambda folder: lines.write.text(folder))
    return files.read_syslog_lines(spark, root).drop("file_path", "file_name", "block", "row")


# Sinks


@query(
    "b1_partitioned_append",
    D + f"SELECT service_name, {_TEXT_PARTS}, message, \"timestamp\" FROM dense",
)
def _(spark, sf):
    root = derive.stored_logs(spark, sf)
    return tables.read_logs(spark, root).select(*model.PARTITION_COLUMNS, "message", "timestamp")


@query("b2_topic_routing", L + "SELECT event_id, 'logs.' || service_name AS topic FROM logs")
def _(spark, sf):
    return log_sink.route_topics(derive.logs(spark, sf)).select("event_id", "topic")


@query(
    "b2_queue_rows",
    D + "SELECT 'logs.' || service_name AS topic, service_name, message, \"timestamp\" FROM dense",
)
def _(spark, sf):
    """Log rows as topic and record bytes, decoded again."""
    rows = log_sink.queue_rows(derive.dense_logs(spark, sf))
    return wire.log_rows(wire.decode_records(rows)).select(
        "topic", "service_name", "message", "timestamp"
    )


# Projections and row transforms


@query(
    "c1_record_decode",
    f"WITH {derive.INGESTED} SELECT event_id, service_name, message, \"timestamp\" FROM ingested",
)
def _(spark, sf):
    rows = wire.log_rows(wire.decode_records(derive.wire_rows(spark, sf)))
    dead = F.col("service_name") == model.DEAD_LETTER_SERVICE
    return rows.select(
        "event_id",
        "service_name",
        "message",
        F.when(~dead, F.col("timestamp")).alias("timestamp"),
    )


@query(
    "c1_out_of_range_time",
    L + """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '__dead_letter__' ELSE service_name END AS service_name,
  CASE WHEN event_id % 3 <> 0 THEN "timestamp" END AS "timestamp" FROM logs""",
)
def _(spark, sf):
    """Every third record has microseconds where its seconds belong."""
    rows = derive.logs(spark, sf)
    seconds = F.when(F.col("event_id") % 3 == 0, F.col("us")).otherwise(
        timefmt.int_div(F.col("us"), 1_000_000)
    )
    nanos = F.pmod(F.col("us"), F.lit(1_000_000)) * 1000
    records = wire.encode_records(rows, F.col("service_name"), F.col("message"), None, seconds, nanos)
    decoded = wire.log_rows(wire.decode_records(records.select("event_id", "value")))
    dead = F.col("service_name") == model.DEAD_LETTER_SERVICE
    return decoded.select("event_id", "service_name", F.when(~dead, F.col("timestamp")).alias("timestamp"))


@query(
    "c2_iso_odd_nanos",
    L + """SELECT event_id, strftime(make_timestamp(us // 1000000 * 1000000 + shift * 500000), '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN shift % 2 = 0 THEN '' ELSE '.500' END || 'Z' AS iso
FROM (SELECT *, event_id % 9 - 4 AS shift FROM logs)""",
)
def _(spark, sf):
    """Nanoseconds from two seconds before to two after the second they go with."""
    nanos = (F.col("event_id") % 9 - 4) * 500_000_000
    iso = timefmt.iso_instant(timefmt.int_div(F.col("us"), 1_000_000), nanos)
    return derive.logs(spark, sf).select("event_id", iso.alias("iso"))


_NANOS = "(us % 1000000) * 1000 + (CASE WHEN user_id > 75 THEN user_id ELSE 0 END)"


@query(
    "c2_iso_text",
    L + f"""SELECT event_id, strftime(moment, '%Y-%m-%dT%H:%M:%S') || CASE
  WHEN nanos = 0 THEN '' WHEN nanos % 1000000 = 0 THEN '.' || lpad(CAST(nanos // 1000000 AS VARCHAR), 3, '0')
  WHEN nanos % 1000 = 0 THEN '.' || lpad(CAST(nanos // 1000 AS VARCHAR), 6, '0')
  ELSE '.' || lpad(CAST(nanos AS VARCHAR), 9, '0') END || 'Z' AS iso
FROM (SELECT *, {_NANOS} AS nanos FROM logs)""",
)
def _(spark, sf):
    nanos = F.pmod(F.col("us"), F.lit(1_000_000)) * 1000 + F.when(
        F.col("user_id") > 75, F.col("user_id")
    ).otherwise(0)
    seconds = timefmt.int_div(F.col("us"), 1_000_000)
    return derive.logs(spark, sf).select("event_id", timefmt.iso_instant(seconds, nanos).alias("iso"))


@query("c3_sql_timestamp", L + "SELECT event_id, us AS micros, us // 1000 AS millis FROM logs")
def _(spark, sf):
    at = timefmt.sql_timestamp(
        timefmt.int_div(F.col("us"), 1_000_000), F.pmod(F.col("us"), F.lit(1_000_000)) * 1000 + 999
    )
    return derive.logs(spark, sf).select(
        "event_id", F.unix_micros(at).alias("micros"), F.unix_millis(at).alias("millis")
    )


@query("c4_time_partitions", L + f"SELECT event_id, {_PARTS} FROM logs")
def _(spark, sf):
    return log_sink.with_time_partitions(derive.logs(spark, sf)).select(
        "event_id", *model.TIME_COLUMNS
    )


def _collected(spark, sf) -> DataFrame:
    """Events as a collector hands them over: JSON body, resources, observed time."""
    rows = derive.logs(spark, sf)
    value = (
        F.when(F.col("event_type") == "error", F.col("props"))
        .when(F.col("event_type") == "view", F.col("user_id").cast("string"))
        .when(F.col("event_type") == "signup", F.lit("null"))
        .otherwise(F.concat(F.lit('"'), "event_type", F.lit(" "), "user_id", F.lit('"')))
    )
    resources = F.when(
        F.col("value") > 10, F.create_map(F.lit("service_name"), F.col("hostname"))
    ).otherwise(F.create_map(F.lit("region"), F.lit("eu")))
    return rows.select(
        "event_id",
        "service_name",
        F.concat(F.lit('{"message": '), value, F.lit("}")).alias("body"),
        resources.alias("resources"),
        F.col("timestamp").alias("observed_timestamp"),
        F.lit("2000-01-01T00:00:00Z").alias("timestamp"),
    )


_VALID = "event_type IN ('click', 'purchase')"


@query(
    "c5_message_normalise",
    L + f"SELECT event_id, CASE WHEN {_VALID} THEN event_type || ' ' || user_id END AS message, "
    f"NOT ({_VALID}) AS invalid FROM logs",
)
def _(spark, sf):
    rows = shaping.normalise_message(_collected(spark, sf), on_invalid="quarantine")
    return rows.select("event_id", F.when(~F.col("invalid"), F.col("message")).alias("message"), "invalid")


@query(
    "c5_message_drop_invalid",
    L + f"SELECT event_id, event_type || ' ' || user_id AS message FROM logs WHERE {_VALID}",
)
def _(spark, sf):
    return shaping.normalise_message(_collected(spark, sf)).select("event_id", "message")


@query(
    "c5_collector_pipeline",
    L + f"""SELECT 'logs.' || svc AS topic, svc AS service_name, event_type || ' ' || user_id AS message, "timestamp", time
FROM (SELECT *, CASE WHEN value > 10 THEN hostname ELSE service_name END AS svc FROM logs) WHERE {_VALID}""",
)
def _(spark, sf):
    """Collected events to topic and record bytes, and from these to stored rows."""
    queued = log_sink.queue_rows(collect.event_rows(_collected(spark, sf)))
    rows = wire.log_rows(wire.decode_records(queued))
    time = timefmt.partition_time(timefmt.epoch_seconds(F.col("timestamp")))
    return rows.select("topic", "service_name", "message", "timestamp", time.alias("time"))


def _one_file_each(rows):
    """Eight tasks of a file each, by its number: by hashes several files meet in one task."""
    return rows.repartitionById(8, F.col("file").cast("int")).sortWithinPartitions("file", "doc_id")


@query(
    "g5_multiline_stream",
    f"""WITH {derive.LINES}, marked AS (
  SELECT doc_id % 8 AS file, doc_id, line_no, line, CAST(sum(CASE WHEN regexp_matches(line, '^[A-L]') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id % 8 ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry FROM lines)
SELECT file, entry, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY doc_id, line_no) AS message
FROM marked GROUP BY file, entry""",
)
def _(spark, sf):
    """Files that arrive one by one."""
    rows = derive.table(spark, sf, "documents").select((F.col("doc_id") % 8).alias("file"), "doc_id", "text")

    def write(folder):
        _one_file_each(rows).select("file", F.col("text").alias("value")).write.partitionBy("file").text(folder)

    source = derive.once(spark, sf, "stream-lines", write)
    root = work_folder(spark, "entries")
    lines = files.read_text_lines(spark, source, stream=True, line_separator="\n", maxFilesPerTrigger="3")
    query_ = collect.start_entry_sink(lines, "^[A-L]", f"{root}/table", f"{root}/checkpoint")
    query_.awaitTermination()
    file = F.regexp_extract("file_path", r"file=(\d+)/", 1).cast("bigint").alias("file")
    return spark.read.parquet(f"{root}/table").select(file, "entry", "n_lines", "message")


@query(
    "c6_service_from_resources",
    L + "SELECT event_id, CASE WHEN value > 10 THEN hostname ELSE service_name END AS service_name FROM logs",
)
def _(spark, sf):
    return shaping.enrich_service(_collected(spark, sf)).select("event_id", "service_name")


@query("c7_event_time", L + "SELECT event_id, \"timestamp\" FROM logs")
def _(spark, sf):
    return shaping.assign_event_time(_collected(spark, sf)).select("event_id", "timestamp")


@query(
    "c8_attribute_upsert",
    L + "SELECT event_id, 'healthcheck' AS service_name, 'us' AS region, "
    "CASE WHEN value > 10 THEN hostname END AS own FROM logs",
)
def _(spark, sf):
    rows = shaping.upsert_attribute(_collected(spark, sf), "service_name", "healthcheck")
    rows = shaping.upsert_attribute(rows, "region", "us", attributes="resources")
    return rows.select(
        "event_id",
        "service_name",
        F.element_at("resources", "region").alias("region"),
        F.element_at("resources", "service_name").alias("own"),
    )


_WORDS = r"^(?P<first>[A-Z][a-z]+) (?P<second>[a-z]+)(?P<rest>.*)$"
_WORDS_RE2 = "^([A-Z][a-z]+) ([a-z]+)(.*)$"


def _group(n: int, name: str) -> str:
    return (
        f"CASE WHEN regexp_matches(line, '{_WORDS_RE2}') "
        f"THEN regexp_extract(line, '{_WORDS_RE2}', {n}) END AS {name}"
    )


@query(
    "c9_named_groups",
    f"WITH {derive.LINES} SELECT doc_id, line_no, {_group(1, 'first')}, {_group(2, 'second')}, "
    f"{_group(3, 'rest')}, regexp_matches(line, '{_WORDS_RE2}') AS matched FROM lines",
)
def _(spark, sf):
    rows = shaping.parse_named_groups(derive.lines(spark, sf), _WORDS)
    return rows.select(
        F.col("file_path").alias("doc_id"),
        F.col("row").cast("bigint").alias("line_no"),
        "first",
        "second",
        "rest",
        "matched",
    )


@query(
    "c10_json_fields",
    "SELECT event_id, props AS message, regexp_extract(props, '\"k\": (\\d+)', 1) AS k FROM events",
)
def _(spark, sf):
    rows = derive.table(spark, sf, "events").select("event_id", F.col("props").alias("message"))
    return shaping.extract_json_fields(rows, keys=shaping.json_keys(rows))


@query(
    "c10_json_many_keys",
    """SELECT event_id, k, v FROM (SELECT event_id, unnest(['id', 'name_' || event_id]) AS k,
  unnest([CAST(event_id AS VARCHAR), event_type]) AS v FROM events)""",
)
def _(spark, sf):
    """As many keys as rows: all of them are in the map."""
    key = F.concat(F.lit("name_"), "event_id")
    body = F.to_json(F.map_from_arrays(F.array(F.lit("id"), key), F.array(F.col("event_id").cast("string"), "event_type")))
    rows = derive.table(spark, sf, "events").select("event_id", body.alias("message"))
    return shaping.extract_json_fields(rows).select("event_id", F.explode("fields").alias("k", "v"))


@query(
    "c10_json_known_fields",
    "SELECT event_id, regexp_extract(props, '\"k\": (\\d+)', 1) AS k, CAST(NULL AS VARCHAR) AS other FROM events",
)
def _(spark, sf):
    rows = derive.table(spark, sf, "events").select("event_id", F.col("props").alias("message"))
    return shaping.extract_json_fields(rows, keys=["k", "other"]).drop("message")


@query("c11_field_include", L + "SELECT event_id, message FROM logs")
def _(spark, sf):
    return shaping.include_fields(derive.logs(spark, sf), ["message", "event_id", "absent"])


@query("c12_column_projection", L + "SELECT hostname, message FROM logs")
def _(spark, sf):
    return shaping.project_columns(derive.logs(spark, sf), ["hostname", "message"])


@query("c13_partition_time", L + "SELECT event_id, time FROM logs")
def _(spark, sf):
    seconds = timefmt.epoch_seconds(F.col("timestamp"))
    rows = derive.logs(spark, sf).withColumn("time", timefmt.partition_time(seconds))
    return rows.select("event_id", "time")


@query("c14_service_from_key", f"WITH {derive.OBJECTS} SELECT path, service_name FROM objects")
def _(spark, sf):
    objects = derive.objects(spark, sf)
    return objects.select("path", keys.service_from_key(F.col("path")).alias("service_name"))


@query(
    "c15_minute_from_key",
    f"WITH {derive.OBJECTS} SELECT path, us // 60000000 * 60 AS minute_seconds, "
    "CAST(hour(moment) AS INTEGER) AS hour, CAST(minute(moment) AS INTEGER) AS minute FROM objects",
)
def _(spark, sf):
    path = F.col("path")
    hour, minute = keys.clock_from_key(path)
    return derive.objects(spark, sf).select(
        "path",
        keys.minute_from_key(path).alias("minute_seconds"),
        hour.alias("hour"),
        minute.alias("minute"),
    )


@query(
    "c17_map_to_json",
    L + "SELECT event_id, CASE WHEN value > 10 THEN '{\"host\":\"' || hostname || '\"}' ELSE '{}' END "
    "AS attributes FROM logs",
)
def _(spark, sf):
    attributes = F.when(F.col("value") > 10, F.create_map(F.lit("host"), F.col("hostname")))
    return derive.logs(spark, sf).select(
        "event_id", patterns.map_to_json(attributes).alias("attributes")
    )


# Filters


@query("d1_minute_range", L + f"SELECT event_id, time FROM logs WHERE {_IN_RANGE}")
def _(spark, sf):
    return predicates.in_minutes(derive.logs(spark, sf), START, END).select("event_id", "time")


@query(
    "d1_exact_range",
    L + "SELECT event_id, \"timestamp\" FROM logs WHERE moment BETWEEN TIMESTAMP '2024-01-05 06:30:20' "
    "AND TIMESTAMP '2024-01-20 18:45:40.5'",
)
def _(spark, sf):
    start, end = START.replace(second=20), END.replace(second=40, microsecond=500_000)
    rows = predicates.in_minutes(derive.logs(spark, sf), start, end, exact=True)
    return rows.select("event_id", "timestamp")


@query(
    "d2_services",
    L + "SELECT event_id, service_name FROM logs WHERE service_name IN ('svc-error', 'svc-view')",
)
def _(spark, sf):
    rows = predicates.of_services(derive.logs(spark, sf), ["svc-error", "svc-view"])
    return rows.select("event_id", "service_name")


def _filtered(spark, sf, predicate, *args) -> DataFrame:
    """Document lines that pass a predicate on the message."""
    rows = derive.lines(spark, sf).select(
        F.col("file_path").alias("doc_id"),
        F.col("row").cast("bigint").alias("line_no"),
        F.col("value").alias("message"),
    )
    return predicate(rows, *args).select("doc_id", "line_no")


_LINE_IDS = f"WITH {derive.LINES} SELECT doc_id, line_no FROM lines WHERE "


@query("d3_text_search", _LINE_IDS + "regexp_matches(line, 'th[ae]r|eau.ou')")
def _(spark, sf):
    return _filtered(spark, sf, predicates.with_text, "th[ae]r,eau.ou")


@query("d3_literal_search", _LINE_IDS + "(contains(line, 'ou.') OR contains(line, '***'))")
def _(spark, sf):
    return _filtered(spark, sf, predicates.with_text, "ou.,***", True)


@query("d4_text_exclude", _LINE_IDS + "NOT regexp_matches(line, 'the|eau|der')")
def _(spark, sf):
    return _filtered(spark, sf, predicates.without_text, "the,eau,der")


@query("d5_regex_search", _LINE_IDS + r"regexp_matches(line, '[A-Z][a-z]+ [a-z]{3} .*\d')")
def _(spark, sf):
    return _filtered(spark, sf, predicates.matching, r"[A-Z][a-z]+ [a-z]{3} .*\d")


@query(
    "d6_hosts",
    L + "SELECT event_id, hostname FROM logs WHERE hostname IN ('host-3', 'host-7', 'host-x')",
)
def _(spark, sf):
    rows = predicates.of_hosts(derive.logs(spark, sf), "host-3,host-7,host-x")
    return rows.select("event_id", "hostname")


@query("d7_no_predicates", L + f"SELECT event_id FROM logs WHERE {_IN_RANGE} AND service_name = 'svc-error'")
def _(spark, sf):
    p = search.SearchParams(["svc-error"], START, END)
    return search.filter_logs(derive.logs(spark, sf), p).select("event_id")


@query("d8_contains", _LINE_IDS + "contains(line, 'tion')")
def _(spark, sf):
    return _filtered(spark, sf, predicates.containing, "tion")


@query("d8_like", _LINE_IDS + "line LIKE '%the%on_'")
def _(spark, sf):
    return _filtered(spark, sf, predicates.like, "%the%on_")


@query(
    "d9_since_in_environment",
    L + "SELECT event_id FROM logs WHERE service_name = 'svc-error' AND user_id >= 50 "
    "AND time >= 'year=2024/month=01/day=15/hour=00/minute=00'",
)
def _(spark, sf):
    env = F.when(F.col("user_id") >= 50, "prod").otherwise("stage")
    rows = predicates.of_environment(derive.logs(spark, sf).withColumn("env", env), "prod")
    rows = predicates.since_minute(predicates.of_services(rows, ["svc-error"]), datetime(2024, 1, 15))
    return rows.select("event_id")


@query(
    "e4_semi_join_list",
    """SELECT p.page_id, p.url FROM pages p WHERE regexp_extract(p.url, '^https?://([^/.]+)', 1) IN (
  SELECT unnest(string_split(lower(text), ' ')) FROM benchmark)""",
)
def _(spark, sf):
    # Hosts named after a word of some benchmark text.
    host = F.regexp_extract("url", "^https?://([^/.]+)", 1)
    pages = derive.table(spark, sf, "pages").select("page_id", "url", host.alias("host"))
    lists = derive.table(spark, sf, "benchmark").select(
        F.regexp_replace(F.lower("text"), " ", ",").alias("hosts"),
    )
    return predicates.of_listed(pages, "host", lists, "hosts").select("page_id", "url")


# Search


_SEARCH = search.SearchParams(
    services=["svc-error", "svc-click", "svc-purchase"],
    start=START,
    end=END,
    text_search='user=1,user=7,"k": 6',
    exclude_text="user=11,user=72",
    regex_search=r"\d \{.*[0-9]\}$",
    hosts="host-1,host-2,host-3,host-5,host-7",
    columns=["service_name", "timestamp", "hostname", "message"],
)
_SEARCH_WHERE = f"""FROM {{table}} WHERE {{range}}
  AND service_name IN ('svc-error', 'svc-click', 'svc-purchase')
  AND regexp_matches(message, 'user=1|user=7|"k": 6')
  AND NOT regexp_matches(message, 'user=11|user=72')
  AND regexp_matches(message, '\\d \\{{{{.*[0-9]\\}}}}$')
  AND hostname IN ('host-1', 'host-2', 'host-3', 'host-5', 'host-7')
"""


def _search_sql(table: str, time_range: str, order: str, limit: int) -> str:
    where = _SEARCH_WHERE.replace("{table}", table).replace("{range}", time_range)
    where = where.replace("{{", "{").replace("}}", "}")
    return f"SELECT service_name, \"timestamp\", hostname, message {where} ORDER BY {order} LIMIT {limit}"


@query("h1_search_newest", L + _search_sql("logs", _IN_RANGE, "us DESC, event_id DESC", 60))
def h1(spark, sf):
    return search.search(derive.logs(spark, sf), _SEARCH, ties=["event_id"])


@query(
    "h1_search_text_order",
    L + _search_sql("logs", _IN_RANGE, '"timestamp" ASC, event_id ASC', 200),
)
def _(spark, sf):
    from dataclasses import replace

    p = replace(_SEARCH, sort="asc", order="text", limit=200)
    return search.search(derive.logs(spark, sf), p, ties=["event_id"])


@query(
    "h1_search_json_fields",
    L + "SELECT message, regexp_extract(message, '\"k\": (\\d+)', 1) AS k FROM (SELECT props AS message, "
    f"us, event_id FROM logs WHERE {_IN_RANGE} AND service_name = 'svc-view' "
    "ORDER BY us DESC, event_id DESC LIMIT 60)",
)
def _(spark, sf):
    rows = derive.logs(spark, sf).withColumn("message", F.col("props"))
    p = search.SearchParams(["svc-view"], START, END, json_fields=True)
    return search.search(rows, p, ties=["event_id"])


# At equal times the stored rows have no id to order by, so ties go by message.
@query(
    "h1_search_projected",
    D + _search_sql("dense", _IN_DENSE_RANGE, "us DESC, message DESC", 60),
)
def _(spark, sf):
    """Only the folders of the searched services and minutes are listed."""
    from dataclasses import replace

    p = replace(_SEARCH, start=DENSE_START, end=DENSE_END)
    logs = tables.read_logs_projected(spark, derive.stored_logs(spark, sf), p.services, p.start, p.end)
    return search.search(logs, p, ties=["message"])


@query(
    "h1_search_stored_table",
    D + _search_sql("dense", _IN_DENSE_RANGE, "us DESC, message DESC", 60),
)
def search_stored(spark, sf):
    from dataclasses import replace

    p = replace(_SEARCH, start=DENSE_START, end=DENSE_END)
    stored = tables.read_logs(spark, derive.stored_logs(spark, sf))
    return search.search(stored, p, ties=["message"])


@query(
    "h1_search_progressive",
    D + _search_sql("dense", _IN_DENSE_RANGE, "us DESC, message DESC", 60),
)
def _(spark, sf):
    """Newest minutes first, in windows that double until sixty rows are found."""
    from dataclasses import replace

    p = replace(_SEARCH, start=DENSE_START, end=DENSE_END)
    return search.search_table(spark, derive.stored_logs(spark, sf), p, ties=["message"])


@query(
    "h1_search_oldest_progressive",
    D + _search_sql("dense", _IN_DENSE_RANGE, "us ASC, message ASC", 500),
)
def _(spark, sf):
    from dataclasses import replace

    p = replace(_SEARCH, start=DENSE_START, end=DENSE_END, sort="asc", limit=500)
    return search.search_table(spark, derive.stored_logs(spark, sf), p, ties=["message"])


@query(
    "h1_search_open_day",
    D + _search_sql("dense", _IN_DENSE_RANGE, "us DESC, message DESC", 5000),
)
def _(spark, sf):
    """A stream's table with a closed tier and files that a failed batch has left."""
    from dataclasses import replace

    root, closed = derive.tiered_logs(spark, sf)
    p = replace(_SEARCH, start=DENSE_START, end=DENSE_END, limit=5000)
    return search.search_table(spark, root, p, closed=closed, ties=["message"])


@query(
    "a6_committed_scan",
    D + "SELECT service_name, time, \"timestamp\", message FROM dense "
    f"WHERE service_name IN ('svc-error', 'svc-click', 'svc-none') AND {_IN_DENSE_RANGE}",
)
def _(spark, sf):
    """Both tiers of a stream's table, whatever else lies in its folders."""
    root, closed = derive.tiered_logs(spark, sf)
    rows = tiers.Tiered(spark, root, closed).read_all(["svc-error", "svc-click", "svc-none"], DENSE_START, DENSE_END)
    return rows.select("service_name", "time", "timestamp", "message")


# Windows, text functions


_ENTRIES = f"""WITH {derive.LINES}, marked AS (
  SELECT doc_id, line_no, line, CAST(sum(CASE WHEN regexp_matches(line, '{{pattern}}') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry
  FROM lines)
SELECT doc_id, entry, count(*) AS n_lines,
  string_agg(line, chr(10) ORDER BY line_no) AS message
FROM marked GROUP BY doc_id, entry"""


@query("g5_multiline_entries", _ENTRIES.replace("{pattern}", "^[A-D]"))
def _(spark, sf):
    entries = multiline.group_multiline(derive.lines(spark, sf), "^[A-D]")
    return entries.withColumnRenamed("file_path", "doc_id")


@query("g5_multiline_small_chunks", _ENTRIES.replace("{pattern}", "^[A-L]"))
def _(spark, sf):
    entries = multiline.group_multiline(derive.lines(spark, sf), "^[A-L]", chunk_lines=3)
    return entries.withColumnRenamed("file_path", "doc_id")


@query(
    "g5_labelled_lines",
    f"""WITH {derive.LINES}, marked AS (
  SELECT doc_id, line_no, line, CAST(sum(CASE WHEN regexp_matches(line, '^[A-L]') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry
  FROM lines)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, entry, line AS message,
  row_number() OVER (PARTITION BY doc_id, entry ORDER BY line_no) - 1 AS line_in_entry FROM marked""",
)
def _(spark, sf):
    """Lines of any number and length, none of them gathered."""
    labelled = multiline.label_lines(derive.lines(spark, sf), "^[A-L]", chunk_lines=3)
    return labelled.select(
        F.col("file_path").alias("doc_id"), F.col("row").cast("bigint").alias("line_no"), "entry", F.col("value").alias("message"), "line_in_entry"
    )


@query(
    "g5_multiline_long_entry",
    f"""WITH {derive.LINES} SELECT doc_id % 3 AS file, CAST(0 AS BIGINT) AS entry, count(*) AS n_lines,
  CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS n_chars FROM lines GROUP BY 1""",
)
def _(spark, sf):
    """No line starts an entry, so that each of three files is one: a third of all text, which no row need hold."""
    rows = derive.lines(spark, sf).withColumn("block", F.col("file_path")).withColumn("file_path", F.col("file_path") % 3)
    parts = multiline.entry_parts(rows, "^no such line")
    # A line feed stands between two parts.
    n_chars = F.sum(F.length("part")) + F.count(F.lit(1)) - 1
    return parts.groupBy(F.col("file_path").alias("file"), "entry").agg(
        F.sum("n_lines").alias("n_lines"), n_chars.cast("bigint").alias("n_chars")
    )


@query(
    "j7_zero_padding",
    "SELECT l_orderkey, l_linenumber, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS padded, "
    "lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 2, '0') AS quantity FROM lineitem",
)
def _(spark, sf):
    return derive.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        timefmt.zero_pad(F.col("l_linenumber")).alias("padded"),
        timefmt.zero_pad(F.col("l_quantity").cast("bigint")).alias("quantity"),
    )


@query(
    "j8_split_list",
    "SELECT element, count(*) AS n FROM (SELECT unnest(string_split(text, ',')) AS element FROM documents) "
    "GROUP BY element",
)
def _(spark, sf):
    elements = derive.table(spark, sf, "documents").select(
        patterns.split_list(F.col("text")).alias("element")
    )
    return elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
