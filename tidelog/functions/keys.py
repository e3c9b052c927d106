"""Reading and building the object keys of the partitioned log table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions import timefmt

SERVICE_PATTERN = "service_name=(.+?)/"
_TIME = r"(year=\d{4}/month=\d{2}/day=\d{2}/hour=\d{2}/minute=\d{2})"
_DAY = r"(year=\d{4}/month=\d{2}/day=\d{2})"
# Fixed value: characters Spark writes as %XX in a partition directory name.
ESCAPED_IN_PATHS = "\"#%'*/:=?\\{[]^\x7f"
_MINUTE_FORMAT = "'year='yyyy'/month='MM'/day='dd'/hour='HH'/minute='mmX"
_DAY_FORMAT = "'year='yyyy'/month='MM'/day='dd"
_CLOCK = r"hour=(\d{2})/minute=(\d{2})"
_SINK_LOG = r"^\d+(\.compact.*)?$"


def service_from_key(path: Column) -> Column:
    """First `service_name=` value of a key, unescaped, NULL where there is none."""
    return unescape(F.nullif(F.regexp_extract(path, SERVICE_PATTERN, 1), F.lit("")))


def escape(value: Column) -> Column:
    """A partition value as Spark writes it into a directory name."""

    def escaped(c: Column) -> Column:
        return F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))

    special = [*ESCAPED_IN_PATHS, *map(chr, range(1, 32))]
    parts = F.transform(
        F.split(value, ""), lambda c: F.when(c.isin(special), escaped(c)).otherwise(c)
    )
    return F.when(value.rlike(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]"), F.array_join(parts, "")).otherwise(value)


def unescape(name: Column) -> Column:
    """The value of a partition directory's name."""
    plain = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(name, F.lit("%")), F.coalesce(plain, name)).otherwise(name)


def time_from_key(path: Column) -> Column:
    """Partition text of the minute of a key, which sorts by time; NULL where it has none."""
    return F.nullif(F.regexp_extract(path, _TIME, 1), F.lit(""))


def day_from_key(path: Column) -> Column:
    """Partition text of the day of a key, NULL where it has none."""
    return F.nullif(F.regexp_extract(path, _DAY, 1), F.lit(""))


def minute_of_time(time: Column) -> Column:
    """Epoch seconds of a partition text, NULL where it is none."""
    return F.unix_seconds(F.try_to_timestamp(F.concat(time, F.lit("Z")), F.lit(_MINUTE_FORMAT)))


def date_of_day(day: Column) -> Column:
    return F.try_to_timestamp(day, F.lit(_DAY_FORMAT)).cast("date")


def env_from_key(path: Column) -> Column:
    """`env=` value of a key, NULL where there is none."""
    return unescape(F.nullif(F.regexp_extract(path, "(?:^|/)env=(.+?)/", 1), F.lit("")))


def minute_from_key(path: Column) -> Column:
    """Epoch seconds of the minute a key belongs to, NULL where the key has none."""
    return minute_of_time(time_from_key(path))


def clock_from_key(path: Column) -> tuple[Column, Column]:
    """Hour and minute of a key as integers, NULL where the key has none."""
    return tuple(F.regexp_extract(path, _CLOCK, i).try_cast("int") for i in (1, 2))


def partition_path(service: Column, seconds: Column) -> Column:
    return F.concat(F.lit("service_name="), escape(service), F.lit("/"), timefmt.partition_time(seconds))


def common_prefix(path: Column, prefix: str, delimiter: str = "/") -> Column:
    """The key up to and with the first delimiter after `prefix`, NULL where none follows."""
    rest = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    at = F.locate(delimiter, rest)
    return F.when(
        path.startswith(prefix) & (at > 0),
        F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1)),
    )


def is_sink_log_name(name: Column) -> Column:
    """Whether a file name of the sink log is a batch number, `.compact` or not."""
    return name.rlike(_SINK_LOG)


def sink_log_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d+)", 1).try_cast("bigint")
