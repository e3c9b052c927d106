"""Session settings and the shared work folder."""

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.streaming.stateless.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pins the runtime settings the table layout depends on; leaves sizing to the user."""
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


@cache
def _own_folder(application: str) -> str:
    """One folder per local session, which itself is left as it is."""
    return tempfile.mkdtemp(prefix=f"tidelog-{application}-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tidelog-{purpose}-{uuid.uuid4().hex}"
