"""Sizing and scaling rules as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import model


def admission_size(
    cores: Column,
    per_core: int = model.ADMISSION_PER_CORE,
    buffer: int = model.ADMISSION_BUFFER,
    smallest: int = model.ADMISSION_MIN,
    largest: int = model.ADMISSION_MAX,
    default: int = model.ADMISSION_DEFAULT,
) -> Column:
    """Records admitted per run for a number of cores, the default where it is unknown."""
    wanted = cores.cast("bigint") * per_core + F.lit(buffer).cast("bigint")
    bounded = F.least(F.lit(largest), F.greatest(F.lit(smallest), wanted))
    return F.when(cores.isNull(), F.lit(default)).otherwise(bounded).cast("bigint")


def admission_records(cores: int | None) -> int:
    """`admission_size` for the options of a stream about to start."""
    if cores is None:
        return model.ADMISSION_DEFAULT
    wanted = cores * model.ADMISSION_PER_CORE + model.ADMISSION_BUFFER
    return min(model.ADMISSION_MAX, max(model.ADMISSION_MIN, wanted))


def workers_from_cores(cores: Column, cores_per_machine: int = model.CORES_PER_MACHINE) -> Column:
    """Machines for a number of cores; NULL for none."""
    return F.ceil(F.nullif(cores, F.lit(0)) / F.lit(cores_per_machine)).cast("int")


def required_workers(
    records: Column,
    buffer: Column,
    per_core: int = model.RECORDS_PER_CORE,
    cores_per_machine: int = model.CORES_PER_MACHINE,
) -> Column:
    """Workers that process `records` plus a buffer share of them."""
    with_buffer = records + F.ceil(buffer * records).cast("bigint")
    cores = F.ceil(with_buffer / F.lit(per_core)).cast("int")
    return workers_from_cores(cores, cores_per_machine)


def compaction_buffer(log_number: Column) -> Column:
    """Extra share of records when the sink log is close to its next compaction."""
    return F.when(F.pmod(log_number, F.lit(10)) >= 7, F.lit(0.5)).otherwise(F.lit(0.0))


def allows_downscale(log_number: Column) -> Column:
    return F.pmod(log_number, F.lit(10)) != 8


def scale_decision(
    actual: Column,
    expected: Column,
    upscale: Column,
    downscale: Column,
    min_workers: int = model.MIN_WORKERS,
    max_workers: int = model.MAX_WORKERS,
) -> Column:
    """Struct of action (`up`, `down` or `none`), target and reason."""
    bounded = F.least(F.lit(max_workers), F.greatest(F.lit(min_workers), expected))
    surplus = actual - bounded
    share = F.lit(1.0) - bounded.cast("double") / F.nullif(actual, F.lit(0))
    step = (
        F.when(
            share >= model.DOWNSCALE_PROPORTION,
            F.ceil(actual * F.lit(model.DOWNSCALE_PROPORTION)).cast("int"),
        )
        .otherwise(surplus)
        .cast("int")
    )
    down_to = actual - F.least(F.lit(model.MAX_DOWNSCALE), step)
    up_to = actual + F.least(F.lit(model.MAX_UPSCALE), -surplus)

    def outcome(action: str, target: Column, reason: str) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            target.cast("int").alias("target"),
            F.lit(reason).alias("reason"),
        )

    no_data = expected.isNull() | (expected == 0) | actual.isNull() | (actual == 0)
    return (
        F.when(no_data, outcome("none", actual, "not enough data"))
        .when(surplus == 0, outcome("none", actual, "already at the expected size"))
        .when((surplus >= model.MIN_DOWNSCALE) & downscale, outcome("down", down_to, "too many workers"))
        .when((-surplus >= model.MIN_UPSCALE) & upscale, outcome("up", up_to, "too few workers"))
        .otherwise(outcome("none", actual, "disabled or step too small"))
    )


def required_partitions(rate: Column, per_partition: int = model.RATE_PER_PARTITION) -> Column:
    return F.ceil(rate / F.lit(per_partition)).cast("int")
