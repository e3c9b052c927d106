"""Schemas and fixed values of the log data model."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def schema_of(columns: str) -> T.StructType:
    """Schema of `name type, name type, ...`; needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Names, order and types of the stored log table.
TIME_COLUMNS = ["year", "month", "day", "hour", "minute"]
PARTITION_COLUMNS = ["service_name", *TIME_COLUMNS]
SEARCH_COLUMNS = ["service_name", "timestamp", "hostname", "message"]

INGEST_SCHEMA = schema_of("message string, timestamp string, service_name string")
# Partition values are read as text: `month=01` must not become the integer 1.
TABLE_SCHEMA = schema_of(
    "hostname string, message string, source_type string, timestamp string, "
    "service_name string, year string, month string, day string, hour string, minute string"
)

# Field names, numbers and types of one record on the wire.
WIRE_FIELDS = {
    "service_name": (1, "string"),
    "message": (2, "string"),
    "log_level": (3, "string"),
    "timestamp": (4, "google.protobuf.Timestamp"),
}

SERVICE_SCHEMA = schema_of(
    "service_name string, retention_days int, tenant string, last_checked_at timestamp"
)
RUN_SCHEMA = schema_of(
    "output_bytes bigint, input_records bigint, submission_time bigint, completion_time bigint, "
    "cores_used int, status string, tenant string, created_at timestamp"
)
OVERRIDE_SCHEMA = schema_of("tenant string, upscale boolean, downscale boolean")
OFFSET_SCHEMA = schema_of("topic string, partition int, end_offset bigint, captured_at timestamp")
OBJECT_SCHEMA = schema_of("path string, length bigint, modification_time timestamp")

# Defaults of retention, search, sizing and scaling.
DEFAULT_RETENTION_DAYS = 3
ENV_RETENTION_DAYS = {"prod": 30}
DEFAULT_SEARCH_LIMIT = 60
MAX_SYNC_DELAY_HOURS = 3
RUN_HISTORY_LENGTH = 5
MONOTONIC_RUNS = 4
RECORDS_PER_CORE = 500_000
CORES_PER_MACHINE = 2
MIN_WORKERS = 2
MAX_WORKERS = 10
MIN_DOWNSCALE = 2
MAX_DOWNSCALE = 50
DOWNSCALE_PROPORTION = 0.25
MIN_UPSCALE = 1
MAX_UPSCALE = 200
RATE_PER_PARTITION = 2000
OFFSET_GAP_SECONDS = (30, 300)
ADMISSION_DEFAULT = 750_000_000
ADMISSION_PER_CORE = 900_000
ADMISSION_BUFFER = 200_000_000
ADMISSION_MIN = 500_000_000
ADMISSION_MAX = 3_500_000_000
TRIGGER_SECONDS = 60
RUN_TIMEOUT_MINUTES = 25
SYSLOG_MAX_BYTES = 102_400
TOPIC_PREFIX = "logs."
TOPIC_PATTERN = "^logs.*"

# Value Spark writes into a directory name for a NULL or empty partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
# Service under which undecodable records are kept, so that none is lost.
DEAD_LETTER_SERVICE = "__dead_letter__"
