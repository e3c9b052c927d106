"""Queries on the service catalogue, freshness and upkeep of the log table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import keys
from tidelog.operators import catalog, freshness, maintenance, metrics
from tidelog.plans import catalog_sync
from tidelog.session import work_folder
from tidelog.sinks import versioned
from tidelog.sources import listing, tables
from workload import derive
from workload.registry import query

C = f"WITH {derive.CATALOG} "
OBJ = f"WITH {derive.OBJECTS} "


def now_timestamp():
    return F.timestamp_seconds(F.lit(derive.NOW_SECONDS))


def now_seconds():
    return F.lit(derive.NOW_SECONDS).cast("bigint")


def _with_millis(rows: DataFrame) -> DataFrame:
    """The catalogue with its check time as milliseconds."""
    return rows.select(
        "service_name",
        "retention_days",
        "tenant",
        F.unix_millis("last_checked_at").alias("checked_millis"),
    )


def _mine(spark, sf) -> DataFrame:
    return tables.tenant_rows(derive.catalog(spark, sf), derive.TENANT)


def _found(spark, sf) -> DataFrame:
    return catalog.stamp_defaults(derive.found_services(spark, sf), derive.TENANT)


_MILLIS = "epoch_ms(CAST(checked AS TIMESTAMP))"
_NOW_MILLIS = f"CAST({derive.NOW_SECONDS}000 AS BIGINT)"


@query(
    "a8_tenant_scan",
    C + f"SELECT service_name, retention_days, tenant, {_MILLIS} AS checked_millis FROM catalog WHERE tenant = 'ABC'",
)
def _(spark, sf):
    return _with_millis(_mine(spark, sf))


@query(
    "b3_catalog_upsert",
    C + f"""SELECT coalesce(c.service_name, f.service_name) AS service_name,
  coalesce(c.retention_days, 3) AS retention_days, coalesce(c.tenant, 'ABC') AS tenant,
  CASE WHEN f.service_name IS NULL THEN {_MILLIS} ELSE {_NOW_MILLIS} END AS checked_millis
FROM (SELECT * FROM catalog WHERE tenant = 'ABC') c FULL JOIN found f USING (service_name)""",
)
def _(spark, sf):
    """Upserted and read back from the table it replaces."""
    root = work_folder(spark, "catalog")
    columns = model.SERVICE_SCHEMA.fieldNames()
    versioned.replace_table(_mine(spark, sf).select(*columns), root)
    current = versioned.read_table(spark, root, model.SERVICE_SCHEMA)
    upserted = catalog.upsert_services(current, _found(spark, sf), now_timestamp())
    versioned.replace_table(upserted, root)
    return _with_millis(versioned.read_table(spark, root, model.SERVICE_SCHEMA))


@query(
    "b4_catalog_delete",
    C + f"SELECT service_name, retention_days, tenant, {_MILLIS} AS checked_millis FROM catalog c "
    "WHERE NOT (tenant = 'ABC' AND service_name IN (SELECT service_name FROM found))",
)
def _(spark, sf):
    left = catalog.delete_services(derive.catalog(spark, sf), _found(spark, sf))
    return _with_millis(left)


@query(
    "b5_catalog_delete_stale",
    C + f"SELECT service_name, retention_days, tenant, {_MILLIS} AS checked_millis FROM catalog "
    "WHERE NOT (tenant = 'ABC' AND checked <= DATE '2024-01-20')",
)
def _(spark, sf):
    since = F.lit("2024-01-20T00:00:00Z").cast("timestamp")
    return _with_millis(catalog.delete_stale(derive.catalog(spark, sf), derive.TENANT, since))


@query(
    "c18_default_stamp",
    C + "SELECT service_name, 3 AS retention_days, 'ABC' AS tenant FROM found",
)
def _(spark, sf):
    return _found(spark, sf)


@query(
    "e1_not_in_catalog",
    C + "SELECT service_name FROM found WHERE service_name NOT IN "
    "(SELECT service_name FROM catalog WHERE tenant = 'ABC')",
)
def _(spark, sf):
    return catalog.not_in_catalog(_found(spark, sf), derive.catalog(spark, sf)).select("service_name")


@query(
    "e2_not_in_store",
    C + "SELECT service_name FROM catalog WHERE tenant = 'ABC' AND service_name NOT IN "
    "(SELECT service_name FROM found)",
)
def _(spark, sf):
    return catalog.not_in_store(_found(spark, sf), _mine(spark, sf)).select("service_name")


@query(
    "e3_sync_plan",
    C + """SELECT coalesce(c.service_name, f.service_name) AS service_name, 'ABC' AS tenant,
  coalesce(c.retention_days, 3) AS retention_days,
  CASE WHEN c.service_name IS NULL THEN 'insert' WHEN f.service_name IS NULL THEN 'delete'
    ELSE 'keep' END AS action
FROM (SELECT * FROM catalog WHERE tenant = 'ABC') c FULL JOIN found f ON c.service_name = f.service_name""",
)
def _(spark, sf):
    return catalog.sync_plan(_found(spark, sf), _mine(spark, sf))


@query(
    "e3_synced_catalog",
    C + f"""SELECT service_name, retention_days, tenant, {_MILLIS} AS checked_millis FROM catalog
WHERE tenant = 'ABC' AND service_name IN (SELECT service_name FROM found)
UNION ALL SELECT service_name, 3, 'ABC', {_NOW_MILLIS} FROM found
WHERE service_name NOT IN (SELECT service_name FROM catalog WHERE tenant = 'ABC')""",
)
def _(spark, sf):
    synced = catalog_sync.synced_catalog(_found(spark, sf), _mine(spark, sf), now_timestamp())
    return _with_millis(synced)


@query(
    "e3_stored_sync",
    f"WITH {derive.DENSE}, {derive.CATALOG}, kept AS (SELECT DISTINCT service_name FROM dense) "
    + f"""SELECT service_name, retention_days, tenant, {_MILLIS} AS checked_millis FROM catalog
WHERE tenant <> 'ABC' OR service_name IN (SELECT service_name FROM kept)
UNION ALL SELECT service_name, 3, 'ABC', {_NOW_MILLIS} FROM kept
WHERE service_name NOT IN (SELECT service_name FROM catalog WHERE tenant = 'ABC')""",
)
def _(spark, sf):
    """Against the top folders of the stored log table; other tenants stay as they are."""
    root = work_folder(spark, "sync")
    columns = model.SERVICE_SCHEMA.fieldNames()
    versioned.replace_table(derive.catalog(spark, sf).select(*columns), root)
    objects = listing.list_top_folders(spark, derive.stored_logs(spark, sf))
    catalog_sync.sync_services(spark, objects, root, derive.TENANT, now=now_timestamp())
    return _with_millis(versioned.read_table(spark, root, model.SERVICE_SCHEMA))


@query("f1_services_of_keys", OBJ + "SELECT DISTINCT service_name FROM objects")
def _(spark, sf):
    return catalog.discover_from_keys(derive.objects(spark, sf))


@query("f1_services_of_table", f"WITH {derive.DENSE} SELECT DISTINCT service_name FROM dense")
def _(spark, sf):
    return catalog.discover_services(tables.read_logs(spark, derive.stored_logs(spark, sf)))


@query(
    "h5_service_picker",
    C + "SELECT service_name FROM catalog WHERE tenant = 'ABC' ORDER BY lower(service_name)",
)
def _(spark, sf):
    return catalog.picker_list(_mine(spark, sf))


@query(
    "i2_differences",
    C + """SELECT 'only found' AS side, service_name FROM (SELECT service_name FROM found
  EXCEPT ALL SELECT service_name FROM catalog WHERE tenant = 'ABC')
UNION ALL SELECT 'only known', service_name FROM (SELECT service_name FROM catalog WHERE tenant = 'ABC'
  EXCEPT ALL SELECT service_name FROM found)""",
)
def _(spark, sf):
    found, known = (rows.select("service_name") for rows in (_found(spark, sf), _mine(spark, sf)))
    only_found = found.exceptAll(known).select(F.lit("only found").alias("side"), "service_name")
    only_known = known.exceptAll(found).select(F.lit("only known").alias("side"), "service_name")
    return only_found.unionByName(only_known)


# Freshness

_RECENT = f"us // 60000000 * 60 BETWEEN {derive.NOW_SECONDS} - 3600 AND {derive.NOW_SECONDS}"
_DELAY = """, services AS (SELECT DISTINCT service_name FROM catalog UNION SELECT service_name FROM objects),
newest AS (SELECT service_name, max(us // 60000000 * 60) AS newest FROM objects
  WHERE us // 60000000 * 60 BETWEEN {first} AND {now} GROUP BY service_name)
SELECT s.service_name,
  CAST(CASE WHEN newest IS NULL THEN 180 ELSE {delay} END AS INTEGER) AS delay_minutes
FROM services s LEFT JOIN newest n USING (service_name)"""


def _delay_sql(delay: str) -> str:
    first = derive.NOW_SECONDS - derive.NOW_SECONDS % 3600 - 3 * 3600
    tail = _DELAY.format(first=first, now=derive.NOW_SECONDS, delay=delay)
    return f"WITH {derive.CATALOG}, {derive.OBJECTS}{tail}"


def _asked_services(spark, sf) -> DataFrame:
    known = derive.catalog(spark, sf).select("service_name")
    return known.unionByName(catalog.discover_from_keys(derive.objects(spark, sf)))


@query(
    "f10_sync_delay",
    _delay_sql(f"least(greatest(({derive.NOW_SECONDS} - newest) // 60, 1), 180)"),
)
def _(spark, sf):
    return freshness.sync_delay(
        _asked_services(spark, sf), derive.objects(spark, sf), now_seconds()
    )


@query(
    "f10_sync_delay_by_clock",
    _delay_sql(
        f"greatest({derive.NOW_SECONDS % 86400 // 60} - (newest % 86400) // 60, 1)"
    ),
)
def _(spark, sf):
    return freshness.sync_delay(
        _asked_services(spark, sf), derive.objects(spark, sf), now_seconds(), legacy_clock=True
    )


@query("d11_recent_objects", OBJ + f"SELECT path FROM objects WHERE {_RECENT}")
def _(spark, sf):
    return freshness.recent_objects(derive.objects(spark, sf), now_seconds()).select("path")


_COUNTS = f"""SELECT count(*) FILTER (WHERE {_RECENT}) AS recent_objects,
  count(DISTINCT service_name) AS total_prefixes FROM objects"""


def _counts(spark, sf) -> DataFrame:
    return freshness.object_counts(derive.objects(spark, sf), "logs/", now_seconds())


@query("f8_object_counts", OBJ + _COUNTS)
def _(spark, sf):
    return _counts(spark, sf)


@query(
    "f9_overall_status",
    OBJ + f"""SELECT CASE WHEN min(CASE WHEN n > 0 THEN 1 ELSE 0 END) = 1 THEN 'UP' ELSE 'DOWN' END AS status,
  count(*) AS checks
FROM (SELECT service_name, count(*) FILTER (WHERE {_RECENT}) AS n FROM objects GROUP BY service_name)""",
)
def _(spark, sf):
    """A freshness check per service, and the status of all."""
    objects = derive.objects(spark, sf)
    recent = freshness.recent_objects(objects, now_seconds())
    service = keys.service_from_key(F.col("path")).alias("service_name")
    found = recent.groupBy(service).agg(F.count(F.lit(1)).alias("recent_objects"))
    counts = (
        catalog.discover_from_keys(objects)
        .join(found, "service_name", "left")
        .na.fill(0, ["recent_objects"])
        .withColumn("total_prefixes", F.lit(1))
    )
    return freshness.overall_status(freshness.freshness_check(counts))


@query("h4_newest_key", OBJ + "SELECT max(path) AS path FROM objects")
def _(spark, sf):
    return freshness.newest_key(derive.objects(spark, sf))


def _hours(relation: str) -> str:
    return f"""SELECT DISTINCT 'service_name=' || service_name || '/' || strftime(
  make_timestamp(({derive.NOW_SECONDS} - h * 3600) * 1000000), 'year=%Y/month=%m/day=%d/hour=%H/minute=') AS prefix
FROM {relation}, (SELECT unnest(range(4)) AS h)"""


@query("j6_hour_grid", C + _hours("found"))
def _(spark, sf):
    return freshness.hour_prefixes(derive.found_services(spark, sf), now_seconds())


@query("i3_distinct_prefixes", f"WITH {derive.LOGS} " + _hours("logs"))
def _(spark, sf):
    """From log rows, so that each prefix arises many times."""
    return freshness.hour_prefixes(derive.logs(spark, sf), now_seconds())


# Upkeep


@query(
    "m1_expired_partitions",
    f"WITH {derive.CATALOG}, {derive.OBJECTS}, days AS (SELECT service_name, max(retention_days) AS d "
    """FROM catalog GROUP BY service_name), stored AS (
  SELECT service_name, CAST(moment AS DATE) AS day, count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes
  FROM objects GROUP BY 1, 2)
SELECT service_name, CAST(day AS VARCHAR) AS day, objects, bytes, coalesce(d, 3) AS retention_days
FROM stored LEFT JOIN days USING (service_name) WHERE day < DATE '2024-01-31' - coalesce(d, 3)""",
)
def _(spark, sf):
    expired = maintenance.expired_partitions(
        derive.objects(spark, sf), derive.catalog(spark, sf), F.lit("2024-01-31").cast("date")
    )
    return expired.withColumn("day", F.col("day").cast("string"))


@query(
    "m2_small_files",
    OBJ + """, sized AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS files,
  CAST(sum(length) AS BIGINT) AS bytes FROM objects GROUP BY 1)
SELECT *, CAST(greatest(1, ceil(bytes / 128000000)) AS BIGINT) AS needed_files FROM sized
WHERE files >= 2 AND files > greatest(1, ceil(bytes / 128000000))""",
)
def _(spark, sf):
    return maintenance.small_file_partitions(derive.objects(spark, sf))


@query(
    "m2_compacted_table",
    f"WITH {derive.DENSE} SELECT service_name, time, count(*) AS n, count(DISTINCT message) AS messages, "
    "CAST(1 AS BIGINT) AS files FROM dense GROUP BY service_name, time",
)
def _(spark, sf):
    target = work_folder(spark, "compacted")
    maintenance.compact_table(spark, derive.stored_logs(spark, sf), target)
    return _compacted(spark, target)


def _compacted(spark, target):
    """Rows and files of each partition."""
    counts = (
        tables.read_logs(spark, target)
        .withColumn("file", F.col("_metadata.file_path"))
        .groupBy("service_name", "time")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("message").alias("messages"),
            F.count_distinct("file").alias("files"),
        )
    )
    return counts


@query(
    "m2_compacted_twice",
    f"WITH {derive.DENSE} SELECT service_name, time, count(*) AS n, count(DISTINCT message) AS messages, "
    "CAST(1 AS BIGINT) AS files FROM dense GROUP BY service_name, time",
)
def _(spark, sf):
    """A second run replaces what the first has written."""
    target = work_folder(spark, "compacted")
    for _ in range(2):
        maintenance.compact_table(spark, derive.stored_logs(spark, sf), target)
    return _compacted(spark, target)


@query(
    "m4_log_counts",
    f"WITH {derive.LOGS} SELECT epoch_ms(time_bucket(INTERVAL 1 minute, moment)) AS window_millis, "
    "service_name, event_type AS level, count(*) AS n FROM logs GROUP BY 1, 2, 3",
)
def _(spark, sf):
    counts = metrics.log_counts(derive.logs(spark, sf), F.col("event_type"))
    return counts.select(
        F.unix_millis("window_start").alias("window_millis"), "service_name", "level", "n"
    )
