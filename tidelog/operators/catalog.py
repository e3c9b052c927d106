"""The service catalogue: discovery, differences, upserts and deletions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import keys

_KEY = ["tenant", "service_name"]


def discover_services(logs: DataFrame) -> DataFrame:
    """Distinct services of log rows, without the one that holds undecodable records.

    Opens every file for its row count; on a large table use `discover_from_keys`.
    """
    service = F.col("service_name")
    return (
        logs.where(service.isNotNull() & (service != model.DEAD_LETTER_SERVICE))
        .select("service_name")
        .distinct()
    )


def discover_from_keys(objects: DataFrame) -> DataFrame:
    """The same from object keys, or from just the table's top folders; reads no log file."""
    return (
        objects.select(keys.service_from_key(F.col("path")).alias("service_name"))
        .where(~F.col("service_name").isin(model.DEAD_LETTER_SERVICE, model.NULL_PARTITION))
        .distinct()
    )


def stamp_defaults(
    services: DataFrame, tenant: str, retention_days: int = model.DEFAULT_RETENTION_DAYS
) -> DataFrame:
    """Gives discovered services their tenant and the default retention."""
    return services.withColumns(
        {"retention_days": F.lit(retention_days), "tenant": F.lit(tenant)}
    )


def not_in_catalog(discovered: DataFrame, catalog: DataFrame) -> DataFrame:
    return discovered.join(catalog, _KEY, "left_anti")


def not_in_store(discovered: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.join(discovered, _KEY, "left_anti")


def sync_plan(discovered: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per service of either side with what to do: insert, delete or keep.

    Equality is by service name in a tenant; retention is not compared.
    """
    found = discovered.groupBy(*_KEY).agg(F.struct(F.min("retention_days").alias("days")).alias("_found"))
    known = catalog.select(*_KEY, F.struct(F.col("retention_days").alias("days")).alias("_known"))
    action = (
        F.when(F.col("_known").isNull(), "insert")
        .when(F.col("_found").isNull(), "delete")
        .otherwise("keep")
    )
    days = F.coalesce("_known", "_found")["days"]
    return found.join(known, _KEY, "full_outer").select(
        *_KEY, days.alias("retention_days"), action.alias("action")
    )


def upsert_services(
    catalog: DataFrame, services: DataFrame, now: Column, touch: bool = True
) -> DataFrame:
    """Catalogue with new services added; of a known one only the check time moves."""
    new = services.groupBy(*_KEY).agg(F.min("retention_days").alias("_new"))
    known = catalog.select(
        *_KEY, "retention_days", "last_checked_at", F.lit(True).alias("_known")
    )
    is_new = F.col("_known").isNull()
    return known.join(new, _KEY, "full_outer").select(
        "service_name",
        F.when(is_new, F.col("_new")).otherwise(F.col("retention_days")).alias("retention_days"),
        "tenant",
        F.when(is_new | (F.col("_new").isNotNull() & F.lit(touch)), now)
        .otherwise(F.col("last_checked_at"))
        .alias("last_checked_at"),
    )


def delete_services(catalog: DataFrame, services: DataFrame) -> DataFrame:
    return catalog.join(services, _KEY, "left_anti").select(*catalog.columns)


def delete_stale(catalog: DataFrame, tenant: str, not_checked_since: Column) -> DataFrame:
    """Catalogue without a tenant's services last checked at or before an instant."""
    stale = (F.col("tenant") == tenant) & (F.col("last_checked_at") <= not_checked_since)
    return catalog.where(~F.coalesce(stale, F.lit(False)))


def upsert_overrides(current: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per tenant: the changed one where there is, NULL switches included."""
    changed = changes.select(
        "tenant", F.struct("upscale", "downscale").alias("_changed")
    )
    kept = current.select("tenant", F.struct("upscale", "downscale").alias("_current"))
    row = F.coalesce("_changed", "_current")
    return kept.join(changed, "tenant", "full_outer").select(
        "tenant", row["upscale"].alias("upscale"), row["downscale"].alias("downscale")
    )


def picker_list(catalog: DataFrame) -> DataFrame:
    """Service names in alphabetical order, whatever their case."""
    return catalog.select("service_name").orderBy(F.lower("service_name"), "service_name")


def services_of(names: Sequence[str], tenant: str, like: DataFrame) -> DataFrame:
    """Catalogue keys from plain names, for a deletion by key."""
    rows = [(name, tenant) for name in names]
    return like.sparkSession.createDataFrame(rows, "service_name string, tenant string")
