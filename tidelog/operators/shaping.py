"""Row transforms between a collected record and a log row, and the columns of a result."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.checks import has_columns, one_of
from tidelog.functions import patterns


def normalise_message(events: DataFrame, body: str = "body", on_invalid: str = "drop") -> DataFrame:
    """Takes `message`, which must be text, from a VARIANT or JSON column.

    Events whose message is missing or not text are dropped, flagged in `invalid`
    (`quarantine`), or kept with the value's text (`pass`).
    """
    one_of("on_invalid", on_invalid, {"drop", "quarantine", "pass"})
    is_json = events.schema[body].dataType.simpleString() == "string"
    value = F.try_parse_json(body) if is_json else F.col(body)
    message = F.try_variant_get(value, "$.message", "variant")
    is_text = F.coalesce(F.schema_of_variant(message) == "STRING", F.lit(False))
    with_message = events.withColumn("message", F.try_variant_get(value, "$.message", "string"))
    if on_invalid == "drop":
        return with_message.where(is_text)
    if on_invalid == "quarantine":
        return with_message.withColumn("invalid", ~is_text)
    return with_message


def enrich_service(events: DataFrame, resources: str = "resources") -> DataFrame:
    """`service_name` of the resources where they have one, else the event's own."""
    own = F.col("service_name") if "service_name" in events.columns else F.lit(None).cast("string")
    return events.withColumn(
        "service_name", F.coalesce(F.element_at(F.col(resources), "service_name"), own)
    )


def assign_event_time(events: DataFrame, observed: str = "observed_timestamp") -> DataFrame:
    """The time of collection is the event time; one parsed from the text stays apart."""
    return events.withColumn("timestamp", F.col(observed))


def upsert_attribute(df: DataFrame, key: str, value: str, attributes: str | None = None) -> DataFrame:
    """Sets a constant attribute, as a column or as an entry of a map column."""
    if attributes is None:
        return df.withColumn(key, F.lit(value))
    others = F.map_filter(F.col(attributes), lambda k, _: k != F.lit(key))
    entry = F.create_map(F.lit(key), F.lit(value))
    return df.withColumn(attributes, F.coalesce(F.map_concat(others, entry), entry))


def parse_named_groups(
    lines: DataFrame, pattern: str, text: str = "value", matched: str | None = "matched"
) -> DataFrame:
    """One column per named group of the pattern, and whether the line matches it."""
    java, _ = patterns.named_groups(pattern)
    groups = patterns.extract_groups(F.col(text), pattern)
    # The text itself may be replaced by a group of its own name, so it is read first.
    kept = [F.col(c) for c in lines.columns if c not in groups]
    flag = [F.coalesce(F.col(text).rlike(java), F.lit(False)).alias(matched)] if matched else []
    return lines.select(*kept, *[column.alias(name) for name, column in groups.items()], *flag)


def json_keys(df: DataFrame, text: str = "message") -> list[str]:
    """Sorted distinct top-level keys of the JSON objects in a column.

    For the few rows of a result: all names reach the driver.
    """
    keys = df.select(F.explode(F.map_keys(_json_map(F.col(text)))).alias("key")).distinct().collect()
    return sorted(row.key for row in keys)


def _json_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def extract_json_map(df: DataFrame, text: str = "message", into: str = "fields") -> DataFrame:
    """All top-level fields as one map column; NULL where the text is no object."""
    return df.withColumn(into, _json_map(F.col(text)))


def extract_json_fields(
    df: DataFrame, text: str = "message", keys: Sequence[str] | None = None, into: str = "fields"
) -> DataFrame:
    """One text column per given JSON key, originals kept; without keys one map of all fields.

    Column names do not tell cases apart: a key named like an existing column is skipped, so
    originals are not replaced, and keys that differ in case share a column, which has the
    value of the first that is there.
    """
    if keys is None:
        return extract_json_map(df, text, into)
    columns: dict[str, list[str]] = {}
    for key in keys:
        columns.setdefault(key.lower(), []).append(key)
    taken = {c.lower() for c in df.columns}
    fields = _json_map(F.col(text))
    new = [
        F.coalesce(*[F.element_at(fields, k) for k in same]).alias(same[0])
        for name, same in columns.items()
        if name not in taken
    ]
    return df.select("*", *new)


def include_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns that exist, whatever their case; all of them where none is named."""
    if not names:
        return df
    wanted = {n.lower() for n in names}
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns if c.lower() in wanted]
    return df.select(*quoted)


def project_columns(logs: DataFrame, columns: Sequence[str] = ("message",)) -> DataFrame:
    """The chosen columns out of those a search offers."""
    for column in columns:
        one_of("column", column, model.SEARCH_COLUMNS)
    has_columns(logs, columns)
    return logs.select(*columns)
