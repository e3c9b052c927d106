"""Small metadata tables that are replaced as a whole.

Every replacement is written to its own directory and becomes current by one row
appended to a commit table, so readers see the old or the new rows, never a mixture,
and a lost job leaves the old ones. A version is committed to a path of its own that must
not exist, and only if the rows it derives from are still current; else the writer fails.
Where the cluster has a table format with `MERGE INTO`, use that instead.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import model
from tidelog.checks import is_missing_path

_COMMITS = model.schema_of("version bigint, directory string, committed_at timestamp")


def _current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    try:
        reader = spark.read.schema(_COMMITS).option("recursiveFileLookup", "true")
        commits = reader.parquet(f"{root}/commits")
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return 0, None
    latest = commits.agg(F.max(F.struct("version", "directory")).alias("latest")).first().latest
    return (latest.version, latest.directory) if latest else (0, None)


def read_table(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The current rows; none where nothing has been written."""
    _, directory = _current(spark, root)
    if directory is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/data/{directory}")


class VersionConflict(RuntimeError):
    """Another writer has replaced the table in the meantime."""


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the current version, 0 where nothing has been written."""
    return _current(spark, root)[0]


def replace_table(df: DataFrame, root: str, derived_from: int | None = None) -> int:
    """Makes the rows of `df`, which may derive from the current ones, the table's content.

    `derived_from` is the version `df` was made of, by default the one found now.
    """
    spark = df.sparkSession
    version = current_version(spark, root) if derived_from is None else derived_from
    directory = f"{version + 1:010d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{root}/data/{directory}")
    if current_version(spark, root) != version:
        raise VersionConflict(f"{root} is no longer at version {version}")
    commit = spark.range(1).select(
        F.lit(version + 1).cast("bigint").alias("version"),
        F.lit(directory).alias("directory"),
        F.current_timestamp().alias("committed_at"),
    )
    try:
        commit.coalesce(1).write.mode("error").parquet(f"{root}/commits/{version + 1:010d}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise VersionConflict(f"{root} has got version {version + 1} from another writer") from error
    return version + 1


def append_rows(df: DataFrame, root: str) -> None:
    """Appends to a plain table, such as the run history."""
    df.write.mode("append").parquet(root)
