"""Predicates of a log search. Each takes rows and returns those that pass."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.checks import not_empty
from tidelog.functions import patterns, timefmt


def partition_time_text(at: datetime) -> str:
    """Partition text of a naive UTC time, whole minutes."""
    return at.strftime("year=%Y/month=%m/day=%d/hour=%H/minute=%M")


def iso_text(at: datetime) -> str:
    """ISO text of a naive UTC time, to the microsecond."""
    fraction = f".{at.microsecond:06d}" if at.microsecond else ""
    return at.strftime("%Y-%m-%dT%H:%M:%S") + fraction + "Z"


def in_minutes(logs: DataFrame, start: datetime, end: datetime, exact: bool = False) -> DataFrame:
    """Rows of whole minutes from `start` to `end`, both included.

    With `exact` rows outside the two instants are left out as well.
    """
    rows = logs.where(F.col("time").between(partition_time_text(start), partition_time_text(end)))
    if exact:
        at = timefmt.instant_order(F.col("timestamp"))
        bounds = [timefmt.instant_order(F.lit(iso_text(t))) for t in (start, end)]
        rows = rows.where(at.between(*bounds))
    return rows


def since_minute(logs: DataFrame, start: datetime) -> DataFrame:
    """Rows of the minute of `start` and all later ones."""
    return logs.where(F.col("time") >= partition_time_text(start))


def of_services(logs: DataFrame, services: Sequence[str]) -> DataFrame:
    """Rows of the given services; naming at least one is required."""
    not_empty("services", services)
    return logs.where(F.col("service_name").isin(list(services)))


def of_environment(logs: DataFrame, env: str) -> DataFrame:
    """Rows of one environment, where the table has that partition column."""
    return logs.where(F.col("env") == env)


def with_text(logs: DataFrame, terms: str, literal: bool = False) -> DataFrame:
    """Rows whose message has one of the comma-separated patterns; no terms, all rows."""
    if not terms:
        return logs
    return logs.where(F.col("message").rlike(patterns.comma_alternatives(terms, literal)))


def without_text(logs: DataFrame, terms: str, literal: bool = False) -> DataFrame:
    """Rows whose message has none of the patterns; a NULL message does not pass."""
    if not terms:
        return logs
    return logs.where(~F.col("message").rlike(patterns.comma_alternatives(terms, literal)))


def matching(logs: DataFrame, regex: str) -> DataFrame:
    return logs.where(F.col("message").rlike(regex)) if regex else logs


def containing(logs: DataFrame, text: str) -> DataFrame:
    return logs.where(F.col("message").contains(text)) if text else logs


def like(logs: DataFrame, pattern: str) -> DataFrame:
    return logs.where(F.col("message").like(pattern)) if pattern else logs


def of_hosts(logs: DataFrame, hosts: str) -> DataFrame:
    """Rows of the comma-separated hosts; rows without a host do not pass."""
    return logs.where(F.col("hostname").isin(hosts.split(","))) if hosts else logs


def of_listed(rows: DataFrame, column: str, lists: DataFrame, list_column: str) -> DataFrame:
    """Rows whose value is an element of some comma-separated text in `lists`."""
    elements = lists.select(patterns.split_list(F.col(list_column)).alias(column)).distinct()
    return rows.join(elements, column, "left_semi")
