"""Run history: rollups of stage events, growth of runs and the latest runs of a tenant."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import timefmt
from tidelog.operators.adjacent import with_adjacent

_MONTH_SECONDS = 30 * timefmt.DAY


def run_rollup(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run from its succeeded stages: largest sizes, first start, last end."""
    return (
        stages.where(F.col("status") == "succeeded")
        .groupBy(run)
        .agg(
            F.max("records_read").alias("input_records"),
            F.max("bytes_written").alias("output_bytes"),
            F.min("submission_time").alias("submission_time"),
            F.max("completion_time").alias("completion_time"),
        )
    )


def stage_counters(events: DataFrame, stage: str = "stage_name") -> DataFrame:
    """Submitted and completed stages per name, and whether the name has completed."""
    completed = F.count_if(F.col("event") == "completed")
    return events.groupBy(stage).agg(
        F.count_if(F.col("event") == "submitted").alias("submitted"),
        completed.alias("completed"),
        (completed > 0).alias("completed_once"),
    )


def all_completed_once(counters: DataFrame, expected_streams: int) -> DataFrame:
    """Whether as many names as there are streams have completed, and every submitted one."""
    seen = F.count_if(F.col("completed") > 0) == expected_streams
    every = F.every((F.col("submitted") == 0) | (F.col("completed") > 0))
    return counters.agg(F.coalesce(seen & every, F.lit(False)).alias("all_completed"))


def latest_runs(runs: DataFrame, limit: int = model.RUN_HISTORY_LENGTH) -> DataFrame:
    """The newest runs of each tenant by creation, numbered from 1 as `run_no`.

    Spark keeps only `limit` rows per tenant in each task before it shuffles.
    """
    newest = Window.partitionBy("tenant").orderBy(
        F.desc("created_at"), F.desc("submission_time"), F.desc("input_records")
    )
    return runs.withColumn("run_no", F.row_number().over(newest)).where(F.col("run_no") <= limit)


def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs of one tenant's rows, newest first."""
    return runs.orderBy(F.desc("created_at"), F.desc("submission_time")).limit(limit)


def by_submission(runs: DataFrame, newest_first: bool = True) -> DataFrame:
    order = F.desc if newest_first else F.asc
    return runs.orderBy(order("submission_time"), order("tenant"))


def growth_rate(newer: Column, older: Column) -> Column:
    """Relative growth; NULL where the older value is 0 and tells nothing."""
    return F.try_divide((newer - older).cast("double"), older.cast("double"))


def run_growth(runs: DataFrame) -> DataFrame:
    """Each run with its predecessor in the same tenant and the growth against it."""
    bucket = timefmt.int_div(timefmt.millis_to_seconds(F.col("submission_time")), _MONTH_SECONDS)
    return with_adjacent(
        runs,
        ["tenant"],
        "submission_time",
        {"previous_records": "input_records"},
        "lag",
        bucket,
    ).withColumn("growth", growth_rate(F.col("input_records"), F.col("previous_records")))


def average_growth(runs: DataFrame) -> DataFrame:
    """Mean growth of consecutive runs per tenant; 0 with fewer than two runs."""
    return (
        run_growth(runs)
        .groupBy("tenant")
        .agg(F.coalesce(F.avg("growth"), F.lit(0.0)).alias("average_growth"))
    )


def series_growth(newest_first: Column) -> Column:
    """Mean growth of an array of values, newest first; 0 with fewer than two."""
    rates = F.filter(
        F.transform(
            F.arrays_zip(
                F.slice(newest_first, 1, F.greatest(F.size(newest_first) - 1, F.lit(0))).alias("newer"),
                F.slice(newest_first, F.lit(2), F.size(newest_first)).alias("older"),
            ),
            lambda pair: growth_rate(pair["newer"], pair["older"]),
        ),
        lambda rate: rate.isNotNull(),
    )
    total = F.aggregate(rates, F.lit(0.0), lambda sum_, rate: sum_ + rate)
    return F.coalesce(F.try_divide(total, F.size(rates)), F.lit(0.0))


def is_rising(newest_first: Column, runs: int = model.MONOTONIC_RUNS) -> Column:
    """Whether none of the newest values is below the one before it."""
    newest = F.slice(newest_first, 1, runs)
    pairs = F.sequence(F.lit(2), F.size(newest))
    rising = F.forall(pairs, lambda i: F.get(newest, i - 2) >= F.get(newest, i - 1))
    return F.when(F.size(newest) < 2, F.lit(True)).otherwise(rising)


def newest_is_largest(newest_first: Column) -> Column:
    return F.get(newest_first, F.lit(0)) == F.array_max(newest_first)


def tenant_series(runs: DataFrame, limit: int = model.RUN_HISTORY_LENGTH) -> DataFrame:
    """Per tenant the record counts of its latest runs, newest submission first, and facts on them.

    An array holds at most `limit` values. `buffer_share` is the growth to plan for: the
    mean growth of a rising series whose newest run is its largest, else 0.
    """
    series = F.transform(
        F.sort_array(F.collect_list(F.struct("submission_time", "run_no", "input_records")), False),
        lambda run: run["input_records"],
    )
    values = F.col("records")
    rising = is_rising(values) & newest_is_largest(values)
    return (
        latest_runs(runs, limit)
        .groupBy("tenant")
        .agg(series.alias("records"))
        .select(
            "tenant",
            "records",
            F.size(values).alias("n_runs"),
            F.array_max(values).alias("max_records"),
            is_rising(values).alias("rising"),
            newest_is_largest(values).alias("newest_is_largest"),
            F.when(rising, F.greatest(F.lit(0.0), series_growth(values)))
            .otherwise(F.lit(0.0))
            .alias("buffer_share"),
        )
    )
