"""Message-queue source and sink, and the options they take."""

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from tidelog import model

# Option names of the Spark source for each field below.
_OPTION_NAMES = {
    "bootstrap_servers": "kafka.bootstrap.servers",
    "fail_on_data_loss": "failOnDataLoss",
    "max_offsets_per_trigger": "maxOffsetsPerTrigger",
    "starting_offsets": "startingOffsets",
    "group_id_prefix": "groupIdPrefix",
    "subscribe_pattern": "subscribePattern",
    "assign": "assign",
    "starting_offsets_by_timestamp": "startingOffsetsByTimestamp",
    "starting_timestamp": "startingTimestamp",
    "min_partitions": "minPartitions",
}


@dataclass(frozen=True)
class QueueOptions:
    """Options of the queue source; those left at None are not passed on."""

    bootstrap_servers: str
    max_offsets_per_trigger: int | None = None
    starting_offsets: str | None = "latest"
    fail_on_data_loss: bool = False
    group_id_prefix: str | None = "application-logs"
    subscribe_pattern: str | None = model.TOPIC_PATTERN
    assign: str | None = None
    starting_offsets_by_timestamp: str | None = None
    starting_timestamp: int | None = None
    min_partitions: int | None = None

    def to_spark(self) -> dict[str, str]:
        given = {k: v for k, v in asdict(self).items() if v is not None}
        return {
            _OPTION_NAMES[k]: str(v).lower() if isinstance(v, bool) else str(v)
            for k, v in given.items()
        }


def read_queue_stream(spark: SparkSession, options: QueueOptions) -> DataFrame:
    """Stream of the record bytes of all subscribed topics; needs the Kafka package."""
    return spark.readStream.format("kafka").options(**options.to_spark()).load().select("value")


def replay_options(options: QueueOptions, since_millis: int) -> QueueOptions:
    """The same source, starting at an instant; use it with a fresh checkpoint folder."""
    changed = asdict(options) | {"starting_timestamp": since_millis, "starting_offsets": None}
    return QueueOptions(**changed)
