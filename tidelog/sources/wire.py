"""Binary log records: encoding on the JVM, decoding in Arrow batches."""

from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import model
from tidelog.checks import one_of
from tidelog.functions import timefmt

_PACKAGE = "tidelog.wire"
_MESSAGE = "LogRecord"
_DECODED = model.schema_of(
    "service_name string, message string, log_level string, seconds bigint, nanos int, corrupt boolean"
)


def descriptor_set() -> bytes:
    """The record's descriptor, as a serialised file descriptor set."""
    try:
        from google.protobuf import descriptor_pb2, timestamp_pb2
    except ImportError as missing:
        raise ImportError("decoding needs the protobuf package") from missing

    kind = descriptor_pb2.FieldDescriptorProto
    clock = descriptor_pb2.FileDescriptorProto()
    timestamp_pb2.DESCRIPTOR.CopyToProto(clock)
    record = descriptor_pb2.FileDescriptorProto(
        name="tidelog_wire.proto", package=_PACKAGE, syntax="proto3", dependency=[clock.name]
    )
    message = record.message_type.add(name=_MESSAGE)
    for name, (number, type_name) in model.WIRE_FIELDS.items():
        field = message.field.add(name=name, number=number, label=kind.LABEL_OPTIONAL)
        if type_name == "string":
            field.type = kind.TYPE_STRING
        else:
            field.type = kind.TYPE_MESSAGE
            field.type_name = f".{type_name}"
    return descriptor_pb2.FileDescriptorSet(file=[clock, record]).SerializeToString()


def has_native_decoder(spark: SparkSession) -> bool:
    """Whether the session has Spark's own protobuf functions loaded."""
    from pyspark.sql.protobuf.functions import from_protobuf

    try:
        _ = spark.range(1).select(
            from_protobuf(F.lit(b""), f"{_PACKAGE}.{_MESSAGE}", binaryDescriptorSet=descriptor_set())
        ).schema
    except PySparkException:
        return False
    return True


def _decode_native(df: DataFrame, value: str) -> DataFrame:
    from pyspark.sql.protobuf.functions import from_protobuf

    record = from_protobuf(
        F.col(value),
        f"{_PACKAGE}.{_MESSAGE}",
        options={"mode": "PERMISSIVE"},
        binaryDescriptorSet=descriptor_set(),
    )
    return df.withColumn("_record", record).select(
        *df.columns,
        F.col("_record.service_name").alias("service_name"),
        F.col("_record.message").alias("message"),
        F.coalesce("_record.log_level", F.lit("")).alias("log_level"),
        F.coalesce("_record.timestamp.seconds", F.lit(0)).cast("bigint").alias("seconds"),
        F.coalesce("_record.timestamp.nanos", F.lit(0)).cast("int").alias("nanos"),
        F.col("_record").isNull().alias("corrupt"),
    )


def _decode_arrow(df: DataFrame, value: str) -> DataFrame:
    descriptors = descriptor_set()
    message_name = f"{_PACKAGE}.{_MESSAGE}"

    def decode(batches: Iterable) -> Iterator:
        # Self-contained, so that executors need only protobuf and Arrow.
        import gc

        import pyarrow as pa
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
        from google.protobuf.message import DecodeError

        # A worker collects garbage after each task, which takes longer than a small batch does when it
        # walks through all that is imported; once frozen, that is left out.
        if not gc.get_freeze_count():
            gc.freeze()

        pool = descriptor_pool.DescriptorPool()
        for file in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
            pool.Add(file)
        record_type = message_factory.GetMessageClass(pool.FindMessageTypeByName(message_name))
        empty = record_type()

        def parse(raw: bytes | None):
            try:
                return record_type.FromString(raw)
            except (DecodeError, TypeError):
                return None

        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).to_pylist()
            parsed = list(map(parse, values))
            records = [empty if r is None else r for r in parsed]
            times = [r.timestamp for r in records]
            columns = {
                "service_name": pa.array([r.service_name for r in records], pa.string()),
                "message": pa.array([r.message for r in records], pa.string()),
                "log_level": pa.array([r.log_level for r in records], pa.string()),
                "seconds": pa.array([t.seconds for t in times], pa.int64()),
                "nanos": pa.array([t.nanos for t in times], pa.int32()),
                "corrupt": pa.array([r is None for r in parsed], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
            )

    return df.mapInArrow(decode, T.StructType([*df.schema.fields, *_DECODED.fields]))


def decode_records(df: DataFrame, value: str = "value", native: bool | None = None) -> DataFrame:
    """Adds the fields of the record in `value`, and whether its bytes are corrupt.

    Absent text fields are empty text and an absent timestamp is the epoch. Uses
    Spark's protobuf functions where the session has them, else Arrow batches.
    """
    if native is None:
        native = has_native_decoder(df.sparkSession)
    return _decode_native(df, value) if native else _decode_arrow(df, value)


def log_rows(
    records: DataFrame,
    on_corrupt: str = "dead_letter",
    on_missing_ts: str = "epoch",
    keep_log_level: bool = False,
    value: str = "value",
    time_partitions: bool = False,
) -> DataFrame:
    """Log rows (`message`, ISO `timestamp`, `service_name`) of decoded records.

    Dead letters are rows of a reserved service: the whole bytes of the record, in base64,
    are their message, so that nothing of it is lost, and the time of ingest is their time,
    so that retention counts from there. `on_corrupt`: `dead_letter`, or `fail`, which ends
    the query. `on_missing_ts`: `epoch`, `ingest_time` or `dead_letter`. Nanoseconds outside
    a second are carried; a time outside the years 1 to 9999 makes a dead letter.
    `time_partitions` adds year to minute without reading the ISO text again.
    """
    one_of("on_corrupt", on_corrupt, {"fail", "dead_letter"})
    one_of("on_missing_ts", on_missing_ts, {"epoch", "ingest_time", "dead_letter"})

    corrupt = F.col("corrupt")
    if on_corrupt == "fail":
        failing = F.raise_error(F.lit("corrupt log record")).cast("boolean")
        corrupt = F.when(corrupt, failing).otherwise(F.lit(False))

    # Every step is used more than once, so that Spark keeps it as a projection of its own and
    # does not write it out again at each use.
    no_time = (F.col("seconds") == 0) & (F.col("nanos") == 0)
    dead = corrupt | ~timefmt.is_storable(F.col("seconds"), F.col("nanos"))
    if on_missing_ts == "dead_letter":
        dead = dead | no_time
    micros = F.unix_micros(F.current_timestamp())
    at_ingest = (F.col("_dead") | no_time) if on_missing_ts == "ingest_time" else F.col("_dead")
    # Inside a lambda, which Spark does not write out as code: the instant changes with each batch of a
    # stream, and as a number in the generated code it would have all of it compiled anew for each batch.
    ingested = F.get(F.transform(F.array(at_ingest), lambda late: F.when(late, micros)), F.lit(0))
    rows = records.withColumn("_dead", dead).withColumn("_ingested", ingested)
    rows = rows.withColumns(
        {
            "_seconds": F.coalesce(timefmt.int_div(F.col("_ingested"), 1_000_000), "seconds"),
            "_nanos": F.coalesce(F.pmod("_ingested", F.lit(1_000_000)) * 1000, "nanos"),
        }
    )
    seconds, nanos = timefmt.carried(F.col("_seconds"), F.col("_nanos"))
    rows = rows.withColumns({"_seconds": seconds, "_nanos": nanos})
    rows = rows.withColumn("_date", timefmt.utc_date(F.col("_seconds")))

    kept = [c for c in records.columns if c not in {value, *_DECODED.fieldNames()}]
    level = ["log_level"] if keep_log_level else []
    parts = timefmt.time_partitions(F.col("_seconds"), F.col("_date")) if time_partitions else {}
    return rows.select(
        *kept,
        F.coalesce(F.when(F.col("_dead"), _base64(value)).otherwise(F.col("message")), F.lit("")).alias("message"),
        timefmt.iso_of_date(F.col("_date"), F.col("_seconds"), F.col("_nanos")).alias("timestamp"),
        F.when(F.col("_dead"), F.lit(model.DEAD_LETTER_SERVICE))
        .otherwise(F.coalesce("service_name", F.lit("")))
        .alias("service_name"),
        *level,
        *[column.alias(name) for name, column in parts.items()],
    )


def _base64(value: str) -> Column:
    """Base64 text on a single line."""
    return F.replace(F.base64(value), F.lit("\r\n"), F.lit(""))


def encode_records(
    df: DataFrame,
    service: Column,
    message: Column,
    level: Column | None,
    seconds: Column,
    nanos: Column,
    value: str = "value",
) -> DataFrame:
    """Adds the wire bytes of a record per row; empty or NULL fields are left out."""
    texts = {"service_name": service, "message": message, "log_level": level}
    texts = {name: text for name, text in texts.items() if text is not None}
    # Columns used more than once get a projection of their own.
    staged = df.withColumns(
        {f"_{name}": F.encode(text, "UTF-8") for name, text in texts.items()}
        | {"_seconds": seconds.cast("bigint"), "_nanos": nanos.cast("bigint")}
    ).withColumns(
        {f"_{name}_size": F.octet_length(f"_{name}").cast("bigint") for name in texts}
        | {"_clock": F.concat(_number_field(1, F.col("_seconds")), _number_field(2, F.col("_nanos")))}
    )
    fields = [_bytes_field(name, F.col(f"_{name}_size"), F.col(f"_{name}")) for name in texts]
    clock_size = F.octet_length("_clock").cast("bigint")
    clock = F.concat(_key("timestamp", 2), _varint(clock_size), F.col("_clock"))
    fields.append(F.when(F.col("_seconds").isNotNull(), clock).otherwise(F.lit(b"")))
    return staged.select(*[F.col(c) for c in df.columns if c != value], F.concat(*fields).alias(value))


_ALL_BYTES = bytes(range(256))
_SHORT_GROUPS = 5


def _byte(number: Column) -> Column:
    return F.substring(F.lit(_ALL_BYTES), number.cast("int") + 1, F.lit(1))


def _varint(number: Column) -> Column:
    """Base-128 bytes, lowest group first, the high bit set on all but the last."""
    limit = 1 << 7 * _SHORT_GROUPS
    short = F.lit(b"")
    for i in reversed(range(_SHORT_GROUPS)):
        group = F.shiftright(number, 7 * i).bitwiseAND(F.lit(127))
        last = number < (1 << 7 * (i + 1))
        short = F.when(last, _byte(group)).otherwise(F.concat(_byte(group + 128), short))
    return F.when((number >= 0) & (number < limit), short).otherwise(_long_varint(number))


def _long_varint(number: Column) -> Column:
    """The same for numbers of any size and sign."""
    size = timefmt.int_div(F.length(F.bin(number)) + 6, 7).cast("int")

    def byte(i: Column) -> Column:
        group = F.call_function("shiftrightunsigned", number, (i - 1) * 7).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(group + F.when(i < size, 128).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), size), byte), ""))


def _key(field: str | int, wire_type: int) -> Column:
    number = field if isinstance(field, int) else model.WIRE_FIELDS[field][0]
    return F.lit(bytes([number << 3 | wire_type]))


def _number_field(number: int, value: Column) -> Column:
    field = F.concat(_key(number, 0), _varint(value))
    return F.when(value != 0, field).otherwise(F.lit(b""))


def _bytes_field(name: str, size: Column, value: Column) -> Column:
    field = F.concat(_key(name, 2), _varint(size), value)
    return F.when(size > 0, field).otherwise(F.lit(b""))
