"""Checks of user parameters."""

from collections.abc import Collection, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def one_of(name: str, given: str, allowed: Collection[str]) -> None:
    if given not in allowed:
        raise ValueError(f"{name} must be one of {sorted(allowed)}, not {given!r}")


def not_empty(name: str, given: Iterable) -> None:
    if not list(given):
        raise ValueError(f"{name} must not be empty")


def has_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def is_missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"
