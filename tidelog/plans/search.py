"""Log search: optional predicates, order, limit, chosen columns, JSON fields."""

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.checks import one_of
from tidelog.functions import timefmt
from tidelog.operators import predicates, shaping
from tidelog.session import work_folder
from tidelog.sources import tables, tiers


@dataclass(frozen=True)
class SearchParams:
    """A search. Empty texts switch their predicate off; times are naive UTC.

    `order='text'` sorts by the timestamp text as stored, where `...00.500Z` comes before
    `...00Z`; `order='instant'` sorts by time.
    """

    services: Sequence[str]
    start: datetime
    end: datetime
    text_search: str = ""
    exclude_text: str = ""
    regex_search: str = ""
    hosts: str = ""
    sort: str = "desc"
    limit: int = model.DEFAULT_SEARCH_LIMIT
    columns: Sequence[str] = ("message",)
    order: str = "instant"
    exact_times: bool = False
    literal_terms: bool = False
    json_fields: bool = False
    json_keys: Sequence[str] | None = None
    include: Sequence[str] = field(default_factory=tuple)


def filter_logs(logs: DataFrame, p: SearchParams) -> DataFrame:
    """Rows that pass every predicate that is switched on."""
    rows = predicates.in_minutes(logs, p.start, p.end, p.exact_times)
    rows = predicates.of_services(rows, p.services)
    rows = predicates.with_text(rows, p.text_search, p.literal_terms)
    rows = predicates.without_text(rows, p.exclude_text, p.literal_terms)
    rows = predicates.matching(rows, p.regex_search)
    return predicates.of_hosts(rows, p.hosts)


def top_rows(
    rows: DataFrame,
    sort: str = "desc",
    limit: int = model.DEFAULT_SEARCH_LIMIT,
    order: str = "instant",
    ties: Sequence[str] = (),
) -> DataFrame:
    """The first rows by time; `ties` orders rows of the same time, in the same direction."""
    one_of("sort", sort, {"asc", "desc"})
    one_of("order", order, {"instant", "text"})
    text = F.col("timestamp")
    keys = [timefmt.instant_order(text), text] if order == "instant" else [text]
    keys += [F.col(c) for c in ties]
    return rows.orderBy(*[k.desc() if sort == "desc" else k.asc() for k in keys]).limit(limit)


def search(logs: DataFrame, p: SearchParams, ties: Sequence[str] = ()) -> DataFrame:
    """The result of a search over log rows with a `time` column."""
    # The order column need not be among the chosen ones, so the projection comes last.
    return present(top_rows(filter_logs(logs, p), p.sort, p.limit, p.order, ties), p)


def present(rows: DataFrame, p: SearchParams) -> DataFrame:
    """Chosen columns and JSON fields of a search's rows, in their order."""
    result = shaping.project_columns(rows, p.columns)
    if p.json_fields and "message" in p.columns:
        keys = p.json_keys
        if keys is None:
            # Looking up the keys runs the search; its few rows are written for the result.
            folder = work_folder(rows.sparkSession, "search")
            result.withColumn("_place", F.monotonically_increasing_id()).coalesce(1).write.parquet(folder)
            result = rows.sparkSession.read.parquet(folder).orderBy("_place").drop("_place")
            keys = shaping.json_keys(result)
        result = shaping.extract_json_fields(result, keys=keys)
    return shaping.include_fields(result, p.include)


def search_table(
    spark: SparkSession,
    root: str,
    p: SearchParams,
    projected: bool = True,
    closed: str | None = None,
    progressive: bool = True,
    ties: Sequence[str] = (),
) -> DataFrame:
    """A search over the table below `root`.

    Only the directories of the searched services and minutes are read; of a table that a stream
    writes only the files it has committed, so that what a failed batch left behind is never
    found. `closed` names the tier of closed days that `tiers.close_until` makes of such a
    table; `projected=False` reads the whole table through the sink's log instead.
    A search by instant goes through the range in windows until it has its rows;
    `progressive=False` sorts the whole range at once.
    """
    if not projected:
        return search(tables.read_logs(spark, root), p, ties)
    source = tiers.Tiered(spark, root, closed)

    def read(start: datetime, end: datetime) -> DataFrame | None:
        return source.read(p.services, start, end)

    if progressive and p.order == "instant":
        return present(search_in_windows(spark, read, p, ties).rows, p)
    return search(source.read_all(p.services, p.start, p.end), p, ties)


@dataclass(frozen=True)
class Windowed:
    """Rows of a search, and the windows (first and last minute) that were read for them."""

    rows: DataFrame
    windows: list[tuple[datetime, datetime]]


_ONE = timedelta(minutes=1)
_MINUTE_FOLDERS = re.compile(r"/year=(\d+)/month=(\d+)/day=(\d+)/hour=(\d+)/minute=(\d+)/")


class MinuteWindows:
    """The minutes from `start` to `end`, both included, in windows that double in length."""

    def __init__(self, start: datetime, end: datetime, newest_first: bool, minutes: int = 1):
        self.first, self.last = (t.replace(second=0, microsecond=0) for t in (start, end))
        self.newest_first, self.least, self.minutes = newest_first, minutes, minutes

    def next(self) -> tuple[datetime, datetime] | None:
        """First and last minute of the next window; None behind the last one."""
        if self.first > self.last:
            return None
        span = timedelta(minutes=self.minutes - 1)
        self.minutes *= 2
        if self.newest_first:
            window = max(self.first, self.last - span), self.last
            self.last = window[0] - _ONE
        else:
            window = self.first, min(self.last, self.first + span)
            self.first = window[1] + _ONE
        return window

    def skip_to(self, minutes: Iterable[datetime], window: tuple[datetime, datetime]) -> None:
        """Goes on with short windows from the first of some minutes, all of which lie in the latest window."""
        if self.newest_first:
            self.last = max(minutes, default=window[1])
        else:
            self.first = min(minutes, default=window[0])
        self.minutes = self.least


def search_in_windows(
    spark: SparkSession,
    read: Callable[[datetime, datetime], DataFrame | None],
    p: SearchParams,
    ties: Sequence[str] = (),
    first_minutes: int = 1,
) -> Windowed:
    """The same rows as `search`, in the same order, of a table partitioned by minute.

    `read` gives the rows of the minutes from one instant to another, both included, or None
    where there are none. Windows are read from the end of the range that comes first,
    each twice as long as the one before, and only until the limit is filled; minutes without
    files are jumped over. Rows of a later window cannot come before those of an earlier one, as a row's partition is the minute
    of its timestamp. A window's rows, at most as many as are still lacking, are written to the
    shared folder, so that nothing is searched twice.
    """
    if p.order != "instant":
        raise ValueError("only a search by instant can go by windows; texts need not be in the order of time")
    one_of("sort", p.sort, {"asc", "desc"})
    folder = work_folder(spark, "windows")
    lacking, seen, schema, skipped = p.limit, [], None, False
    windows = MinuteWindows(p.start, p.end, p.sort == "desc", first_minutes)
    while lacking > 0 and (window := windows.next()):
        logs = read(*window)
        if logs is None:
            skipped = True
            continue
        if skipped:
            # Behind a gap the window is long; only where its files begin is of interest.
            skipped = False
            found = (_MINUTE_FOLDERS.search(path) for path in logs.inputFiles())
            windows.skip_to((datetime(*map(int, m.groups())) for m in found if m), window)
            continue
        number = len(seen)
        seen.append(window)
        rows = top_rows(filter_logs(logs, p), p.sort, lacking, p.order, ties)
        placed = rows.withColumns({"_window": F.lit(number), "_place": F.monotonically_increasing_id()})
        placed.coalesce(1).write.parquet(f"{folder}/{number}")
        schema = placed.schema
        lacking -= spark.read.schema(schema).parquet(f"{folder}/{number}").count()
    if schema is None:
        return Windowed(filter_logs(tables.no_logs(spark), p).limit(0), seen)
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return Windowed(found.orderBy("_window", "_place").drop("_window", "_place"), seen)
