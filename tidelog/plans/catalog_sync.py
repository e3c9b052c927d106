"""Bringing the stored catalogue in line with the services found in the log table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.operators import catalog
from tidelog.sinks import versioned


def synced_catalog(discovered: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """The catalogue with new services added and vanished ones removed; others untouched.

    One join of both sides gives all of it.
    """
    key = ["tenant", "service_name"]
    found = discovered.groupBy(*key).agg(F.min("retention_days").alias("_days"))
    known = current.select(*key, F.struct("retention_days", "last_checked_at").alias("_known"))
    is_new = F.col("_known").isNull()
    return found.join(known, key, "left").select(
        "service_name",
        F.when(is_new, F.col("_days")).otherwise(F.col("_known.retention_days")).alias("retention_days"),
        "tenant",
        F.when(is_new, now).otherwise(F.col("_known.last_checked_at")).alias("last_checked_at"),
    )


def sync_services(
    spark: SparkSession,
    objects: DataFrame,
    catalog_root: str,
    tenant: str,
    retention_days: int = model.DEFAULT_RETENTION_DAYS,
    now: Column | None = None,
) -> int:
    """Synchronises one tenant's part of the stored catalogue; returns its new version.

    Another writer's version in the meantime is an error: nothing is written over it.
    """
    version = versioned.current_version(spark, catalog_root)
    stored = versioned.read_table(spark, catalog_root, model.SERVICE_SCHEMA)
    mine = stored.where(F.col("tenant") == tenant)
    others = stored.where(F.col("tenant") != tenant)
    found = catalog.stamp_defaults(catalog.discover_from_keys(objects), tenant, retention_days)
    synced = synced_catalog(found, mine, now if now is not None else F.current_timestamp())
    columns = model.SERVICE_SCHEMA.fieldNames()
    return versioned.replace_table(
        synced.select(*columns).unionByName(others.select(*columns)), catalog_root, version
    )
