"""Listings of stored objects, made by Spark tasks rather than by the driver."""

from collections.abc import Iterable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import keys

# Schemes that name the same store for Spark and for Arrow.
_ARROW_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "abfss://": "abfs://"}
_ENTRY = model.schema_of("path string, length bigint, modification_time timestamp, is_folder boolean")


def _arrow_uri(root: str) -> str:
    for scheme, arrow in _ARROW_SCHEMES.items():
        if root.startswith(scheme):
            return arrow + root[len(scheme) :]
    return root


def _expand(entries: DataFrame, root: str, recursive: bool) -> DataFrame:
    """Replaces each folder by what lies in it, or anywhere below it; objects stay."""
    uri = _arrow_uri(root)

    def expand(batches: Iterable) -> Iterator:
        # Self-contained, so that executors need only Arrow.
        import pyarrow as pa
        from pyarrow import compute, fs

        system, base = fs.FileSystem.from_uri(uri)
        base = base.rstrip("/")
        schema = pa.schema(
            [
                ("path", pa.string()),
                ("length", pa.int64()),
                ("modification_time", pa.timestamp("us", "UTC")),
                ("is_folder", pa.bool_()),
            ]
        )

        def visible(path: str) -> bool:
            return not any(part[:1] in ("_", ".") for part in path.split("/"))

        for batch in batches:
            yield batch.filter(compute.invert(batch.column("is_folder"))).cast(schema)
            for row in batch.filter(batch.column("is_folder")).to_pylist():
                folder = f"{base}/{row['path']}".rstrip("/")
                # A folder may be absent, the root may not: nothing below a wrong path is
                # not the same as an empty table.
                selector = fs.FileSelector(folder, allow_not_found=bool(row["path"]), recursive=recursive)
                found = []
                for info in system.get_file_info(selector):
                    path = info.path[len(base) + 1 :]
                    is_folder = info.type == fs.FileType.Directory
                    if visible(path) and not (is_folder and recursive):
                        found.append(
                            {
                                "path": path,
                                "length": info.size,
                                "modification_time": info.mtime,
                                "is_folder": is_folder,
                            }
                        )
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return entries.mapInArrow(expand, _ENTRY)


def _spread(entries: DataFrame, tasks: int | None) -> DataFrame:
    """A fixed number of tasks: few bytes of names stand for many requests to the store."""
    parallel = tasks or 2 * entries.sparkSession.sparkContext.defaultParallelism
    return entries.repartition(parallel, "path")


def _folders(paths: DataFrame) -> DataFrame:
    return paths.select(
        "path",
        F.lit(None).cast("bigint").alias("length"),
        F.lit(None).cast("timestamp").alias("modification_time"),
        F.lit(True).alias("is_folder"),
    )


def list_objects(
    spark: SparkSession,
    root: str,
    prefix: str = "",
    spread_levels: int = 3,
    tasks: int | None = None,
) -> DataFrame:
    """Path below `root`, length and modification time of its objects; none is opened.

    The folders of each of the first levels are spread over tasks, which list them in
    parallel; below that a task lists whole folders. `tasks` is by default twice the
    session's parallelism; set it where executors are added on demand. Names that start
    with `_` or `.` are left out, as Spark's readers do.
    """
    entries = _folders(spark.range(1).select(F.lit("").alias("path")))
    for _ in range(spread_levels):
        entries = _expand(entries, root, recursive=False)
        if prefix:
            # Folders that lead to the prefix, and all that starts with it.
            path = F.col("path")
            leads = F.lit(prefix).startswith(F.concat(path, F.lit("/")))
            entries = entries.where(path.startswith(prefix) | leads)
        entries = _spread(entries, tasks)
    objects = _expand(entries, root, recursive=True).drop("is_folder")
    return with_prefix(objects, prefix)


def list_folders(root: str, folders: DataFrame, tasks: int | None = None) -> DataFrame:
    """Objects anywhere below the folders (`path`, relative to `root`); absent ones have none.

    Arrow's file systems do the listing; they take their credentials and endpoints from the
    environment of the executors, not from the session's Hadoop settings.
    """
    distinct = _folders(folders.select("path").distinct())
    return _expand(_spread(distinct, tasks), root, recursive=True).drop("is_folder")


def list_common_prefixes(objects: DataFrame, prefix: str, delimiter: str = "/") -> DataFrame:
    """Distinct key prefixes up to the first delimiter after `prefix`."""
    return (
        with_prefix(objects, prefix)
        .select(keys.common_prefix(F.col("path"), prefix, delimiter).alias("prefix"))
        .where(F.col("prefix").isNotNull())
        .distinct()
    )


def list_top_folders(spark: SparkSession, root: str) -> DataFrame:
    """The folders directly below `root`, each with a closing slash: one request."""
    top = _expand(_folders(spark.range(1).select(F.lit("").alias("path"))), root, recursive=False)
    return top.where("is_folder").select(F.concat("path", F.lit("/")).alias("path"))


def with_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.where(F.col("path").startswith(prefix)) if prefix else objects


def list_hidden_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files directly in one small folder that readers skip, such as a sink's log.

    Asks the file system on the driver; a sink's log keeps only its latest files.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    statuses = system.listStatus(path) if system.exists(path) else []
    rows = [
        (s.getPath().toString(), s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000))
        for s in statuses
        if s.isFile()
    ]
    return spark.createDataFrame(rows, model.OBJECT_SCHEMA)
