"""Instants, their ISO text and the minute partitions derived from them.

Everything is computed from epoch seconds, so no result depends on the session
time zone.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
NANOS = 1_000_000_000
# Seconds of the years 1 to 9999, which ISO text and partitions can hold.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def int_div(a: Column, b) -> Column:
    """Integer division, as `a div b` in SQL."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def zero_pad(value: Column, width: int = 2) -> Column:
    """The value's text with zeros before it; one that is longer stays whole."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def carried(seconds: Column, nanos: Column) -> tuple[Column, Column]:
    """The same instant with nanoseconds from 0 to 999999999."""
    below = F.pmod(nanos.cast("bigint"), F.lit(NANOS).cast("bigint"))
    return seconds + int_div(nanos.cast("bigint") - below, NANOS), below


def is_storable(seconds: Column, nanos: Column) -> Column:
    """Whether an instant lies in the years that can be written; for seconds of any size."""
    near = seconds.between(F.lit(FIRST_SECOND - 3), F.lit(LAST_SECOND + 3))
    whole, _ = carried(F.when(near, seconds), nanos)
    return F.coalesce(whole.between(F.lit(FIRST_SECOND), F.lit(LAST_SECOND)), F.lit(False))


def utc_date(seconds: Column) -> Column:
    """Date of an instant, NULL outside the years 1 to 9999."""
    inside = F.when(seconds.between(F.lit(FIRST_SECOND), F.lit(LAST_SECOND)), seconds)
    days = int_div(inside - F.pmod(inside, F.lit(DAY)), DAY)
    return F.date_from_unix_date(days.cast("int"))


def _hour(seconds: Column) -> Column:
    return int_div(F.pmod(seconds, F.lit(DAY)), 3600)


def _minute(seconds: Column) -> Column:
    return int_div(F.pmod(seconds, F.lit(3600)), 60)


def iso_instant(seconds: Column, nanos: Column) -> Column:
    """ISO-8601 text in UTC with 0, 3, 6 or 9 fraction digits, as few as keep every nanosecond.

    Nanoseconds outside a second are carried; NULL outside the years 1 to 9999.
    """
    seconds, nanos = carried(seconds, nanos)
    return iso_of_date(utc_date(seconds), seconds, nanos)


def iso_of_date(date: Column, seconds: Column, nanos: Column) -> Column:
    """The same text where the date is known and the nanoseconds are inside a second."""
    fraction = (
        F.when(nanos == 0, F.lit(""))
        .when(nanos % 1_000_000 == 0, F.concat(F.lit("."), zero_pad(int_div(nanos, 1_000_000), 3)))
        .when(nanos % 1_000 == 0, F.concat(F.lit("."), zero_pad(int_div(nanos, 1_000), 6)))
        .otherwise(F.concat(F.lit("."), zero_pad(nanos, 9)))
    )
    return F.concat(
        date.cast("string"),
        F.lit("T"),
        zero_pad(_hour(seconds)),
        F.lit(":"),
        zero_pad(_minute(seconds)),
        F.lit(":"),
        zero_pad(F.pmod(seconds, F.lit(60))),
        fraction,
        F.lit("Z"),
    )


def sql_timestamp(seconds: Column, nanos: Column) -> Column:
    """Timestamp of microsecond precision; digits beyond are cut."""
    return F.timestamp_micros(seconds * 1_000_000 + int_div(nanos, 1_000))


def instant(iso_text: Column) -> Column:
    """Timestamp of an ISO text, NULL where the text is none."""
    return F.try_to_timestamp(iso_text)


def epoch_seconds(iso_text: Column) -> Column:
    return F.unix_seconds(instant(iso_text))


def instant_order(iso_text: Column) -> Column:
    """Text that sorts in time order whatever the number of fraction digits."""
    fraction = F.substring(iso_text, F.lit(21), F.length(iso_text) - 21)
    return F.concat(F.substring(iso_text, 1, 19), F.rpad(fraction, 9, "0"))


def time_partitions(seconds: Column, date: Column | None = None) -> dict[str, Column]:
    """`year` as integer; month, day, hour and minute as two-digit text; `date` is the instant's, if known."""
    date = utc_date(seconds) if date is None else date
    return {
        "year": F.year(date),
        "month": zero_pad(F.month(date)),
        "day": zero_pad(F.dayofmonth(date)),
        "hour": zero_pad(_hour(seconds)),
        "minute": zero_pad(_minute(seconds)),
    }


def partition_time(seconds: Column) -> Column:
    """`year=YYYY/month=MM/day=dd/hour=HH/minute=mm` of an instant."""
    parts = time_partitions(seconds)
    parts["year"] = zero_pad(parts["year"], 4)
    return _join_parts(parts)


def partition_time_of_columns() -> Column:
    """The same text from the partition columns; Spark prunes partitions on it."""
    return _join_parts({name: F.col(name) for name in ("year", "month", "day", "hour", "minute")})


def _join_parts(parts: dict[str, Column]) -> Column:
    return F.concat_ws("/", *[F.concat(F.lit(f"{name}="), value) for name, value in parts.items()])


def millis_to_seconds(millis: Column) -> Column:
    return int_div(millis, 1000)


def elapsed_seconds(earlier_millis: Column, later_millis: Column) -> Column:
    """Whole seconds between two epoch-millisecond values, cut towards zero."""
    return int_div(later_millis - earlier_millis, 1000)
