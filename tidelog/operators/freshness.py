"""How fresh the stored logs are."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import keys, timefmt


def newest_minutes(objects: DataFrame) -> DataFrame:
    """Newest minute with an object per service, from the keys alone.

    Partition text sorts like time, so that one value per service is parsed.
    """
    path = F.col("path")
    newest = objects.groupBy(keys.service_from_key(path).alias("service_name")).agg(
        F.max(keys.time_from_key(path)).alias("_time")
    )
    return newest.select("service_name", keys.minute_of_time(F.col("_time")).alias("newest"))


def _between(objects: DataFrame, first_seconds: Column, last_seconds: Column) -> DataFrame:
    """Objects of the minutes from one instant to another, compared as partition text."""
    time = keys.time_from_key(F.col("path"))
    # A key's minute counts from its first second on.
    start = timefmt.partition_time(first_seconds + F.pmod(-first_seconds, F.lit(60)))
    return objects.where(time.between(start, timefmt.partition_time(last_seconds)))


def sync_delay(
    services: DataFrame,
    objects: DataFrame,
    now_seconds: Column,
    max_hours: int = model.MAX_SYNC_DELAY_HOURS,
    legacy_clock: bool = False,
) -> DataFrame:
    """Minutes between now and the newest stored minute per service, from 1 to the cap.

    A service without objects in the last hours has the cap. With `legacy_clock` only
    hour and minute of day are compared, so that a delay across midnight becomes 1.
    """
    first_hour = (now_seconds - max_hours * 3600) - F.pmod(now_seconds, F.lit(3600))
    newest = newest_minutes(_between(objects, first_hour, now_seconds))
    if legacy_clock:
        clock = F.pmod(F.col("newest"), F.lit(timefmt.DAY))
        now_clock = F.pmod(now_seconds, F.lit(timefmt.DAY))
        delay = timefmt.int_div(now_clock, 60) - timefmt.int_div(clock, 60)
    else:
        delay = timefmt.int_div(now_seconds - F.col("newest"), 60)
    cap = F.lit(max_hours * 60)
    bounded = F.greatest(delay, F.lit(1))
    if not legacy_clock:
        bounded = F.least(bounded, cap)
    return (
        services.select("service_name")
        .distinct()
        .join(newest, "service_name", "left")
        .select(
            "service_name",
            F.when(F.col("newest").isNull(), cap).otherwise(bounded).cast("int").alias("delay_minutes"),
        )
    )


def recent_objects(objects: DataFrame, now_seconds: Column, hours: int = 1) -> DataFrame:
    """Objects whose minute lies in the last hours."""
    return _between(objects, now_seconds - hours * 3600, now_seconds)


def object_counts(objects: DataFrame, prefix: str, now_seconds: Column, hours: int = 1) -> DataFrame:
    """Number of recent objects and of common prefixes below `prefix`."""
    path = F.col("path")
    minute = keys.minute_from_key(path)
    recent = F.call_function("between", minute, now_seconds - hours * 3600, now_seconds)
    return objects.agg(
        F.count_if(recent & path.startswith(prefix)).alias("recent_objects"),
        F.count_distinct(keys.common_prefix(path, prefix)).alias("total_prefixes"),
    )


def freshness_check(counts: DataFrame) -> DataFrame:
    """The counts with a status: UP with recent objects, else WARNING."""
    message = (
        F.when(F.col("total_prefixes") == 0, "no log prefixes found")
        .when(F.col("recent_objects") > 0, "recent logs found")
        .otherwise("no recent logs found")
    )
    status = F.when(F.col("recent_objects") > 0, "UP").otherwise("WARNING")
    return counts.select("*", status.alias("status"), message.alias("check_message"))


def overall_status(checks: DataFrame) -> DataFrame:
    """UP if every check is UP."""
    return checks.agg(
        F.when(F.every(F.col("status") == "UP"), "UP").otherwise("DOWN").alias("status"),
        F.count(F.lit(1)).alias("checks"),
    )


def newest_key(objects: DataFrame) -> DataFrame:
    """The last key in lexicographic order."""
    return objects.agg(F.max("path").alias("path"))


def hour_folders(
    services: DataFrame, now_seconds: Column, hours: int = model.MAX_SYNC_DELAY_HOURS
) -> DataFrame:
    """Folders of those hours, the only ones to list for a delay of at most `hours`."""
    prefix = F.regexp_replace("prefix", "/minute=$", "")
    return hour_prefixes(services, now_seconds, hours).select(prefix.alias("path"))


def hour_prefixes(
    services: DataFrame, now_seconds: Column, hours: int = model.MAX_SYNC_DELAY_HOURS
) -> DataFrame:
    """Distinct key prefixes of each service's current and previous hours."""
    back = F.explode(F.sequence(F.lit(0), F.lit(hours)))
    hour = now_seconds - F.col("hours_back") * 3600
    minute_path = keys.partition_path(F.col("service_name"), hour)
    return (
        services.select("service_name", back.alias("hours_back"))
        .select(F.regexp_replace(minute_path, r"minute=\d{2}$", "minute=").alias("prefix"))
        .distinct()
    )
