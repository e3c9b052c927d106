"""Worker recommendations per tenant from run history, sink log and switches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import sizing
from tidelog.operators import history


def resolve_switches(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """Requested switches per tenant; an override that is not NULL wins."""
    given = overrides.select(
        "tenant", F.col("upscale").alias("_upscale"), F.col("downscale").alias("_downscale")
    )
    return requests.join(given, "tenant", "left").select(
        "tenant",
        F.coalesce("_upscale", "upscale").alias("upscale"),
        F.coalesce("_downscale", "downscale").alias("downscale"),
    )


def expected_workers(
    runs: DataFrame,
    log_numbers: DataFrame,
    per_core: int = model.RECORDS_PER_CORE,
    cores_per_machine: int = model.CORES_PER_MACHINE,
    history_length: int = model.RUN_HISTORY_LENGTH,
) -> DataFrame:
    """Workers each tenant's runs call for; NULL with too short a history.

    `log_numbers` has the tenant's latest sink log `number` and whether it is `compacted`.
    """
    number = F.col("number")
    buffer = F.col("buffer_share") + sizing.compaction_buffer(number)
    workers = sizing.required_workers(F.col("max_records"), buffer, per_core, cores_per_machine)
    enough = F.col("n_runs") >= history_length
    return (
        history.tenant_series(runs, history_length)
        .join(log_numbers, "tenant")
        .select(
            "tenant",
            "number",
            "compacted",
            "max_records",
            buffer.alias("buffer_share"),
            F.when(enough, workers).alias("expected"),
        )
    )


def recommend_workers(
    runs: DataFrame,
    log_numbers: DataFrame,
    actual_workers: DataFrame,
    requests: DataFrame,
    overrides: DataFrame,
    min_workers: int = model.MIN_WORKERS,
    max_workers: int = model.MAX_WORKERS,
    per_core: int = model.RECORDS_PER_CORE,
    cores_per_machine: int = model.CORES_PER_MACHINE,
) -> DataFrame:
    """One row per tenant with `action`, `target` and `reason`; applying it is up to the cluster."""
    inputs = (
        expected_workers(runs, log_numbers, per_core, cores_per_machine)
        .join(actual_workers, "tenant")
        .join(resolve_switches(requests, overrides), "tenant")
    )
    decision = sizing.scale_decision(
        F.col("actual"),
        F.col("expected"),
        F.col("upscale"),
        F.col("downscale") & sizing.allows_downscale(F.col("number")),
        min_workers,
        max_workers,
    )

    def skip(reason: str):
        return F.struct(
            F.lit("none").alias("action"), F.col("actual").alias("target"), F.lit(reason).alias("reason")
        )

    decided = (
        F.when(~(F.col("upscale") | F.col("downscale")), skip("scaling is switched off"))
        .when(F.col("compacted"), skip("latest sink log is compacted"))
        .otherwise(decision)
    )
    return inputs.withColumn("_decision", decided).select(
        "tenant", "actual", "expected", "_decision.*"
    )
