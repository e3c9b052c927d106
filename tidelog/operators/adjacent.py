"""Previous, next or latest row of a key, without sorting a whole key in one task."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.checks import has_columns, one_of


def with_adjacent(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, str],
    direction: str,
    bucket: Column,
) -> DataFrame:
    """Adds, under new names, values of the previous (`lag`) or next (`lead`) row by `order`.

    One key may hold most rows, so the neighbour is looked up inside a (key, bucket)
    first; `bucket` must not decrease with `order`. Only one edge row per bucket is
    sorted by key, to link each bucket with the next that has rows. Keys are not NULL
    and `order` is unique in a key.
    """
    one_of("direction", direction, {"lag", "lead"})
    shift, edge_of = (F.lag, F.max_by) if direction == "lag" else (F.lead, F.min_by)
    row = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    place = [*keys, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket).withColumn("_row", row)
    in_bucket = Window.partitionBy(*place).orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = (
        bucketed.groupBy(*place)
        .agg(edge_of("_row", order).alias("_edge"))
        .select(*place, shift("_edge").over(across).alias("_beyond"))
    )
    neighbour = F.coalesce("_near", "_beyond")
    return (
        bucketed.withColumn("_near", shift("_row").over(in_bucket))
        .join(edges, place, "left")
        .select(*df.columns, *[neighbour[name].alias(name) for name in values])
    )


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Mapping[str, str],
    bucket: Callable[[Column], Column],
    since: str | None = None,
) -> DataFrame:
    """Each left row with values of the latest right row of its keys at or before its time `at`.

    `since` is the right rows' time, `at` by default; `values` gives new names to right columns; they are
    NULL where there is no such row. One key may hold most rows: the rows of both sides are shuffled once, by key
    and bucket, and only the buckets' last right rows, aggregated before they are moved, are sorted by key. `bucket` makes a coarse time of a time and must not decrease with
    it. Of right rows of one time the one with the greatest values, by their order, counts. Rows without a time, or
    with a NULL among the keys, match nothing.
    """
    since = since or at
    has_columns(left, [*keys, at])
    has_columns(right, [*keys, since, *values.values()])
    key_names = [f"_key{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, key_names, strict=True)]
    found = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    asking = left.select(*named, F.col(at).alias("_at"), F.struct("*").alias("_left"))
    given = right.select(*named, F.col(since).alias("_at"), found.alias("_right")).where(F.col("_at").isNotNull())
    both = asking.unionByName(given, allowMissingColumns=True).withColumn("_bucket", bucket(F.col("_at")))
    place = [*key_names, "_bucket"]
    # At one time right rows come before left ones, in the order of their values.
    so_far = Window.partitionBy(*place).orderBy(F.col("_at"), F.col("_left").isNotNull(), "_right").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_near", F.last("_right", ignorenulls=True).over(so_far)).where(F.col("_left").isNotNull())
    # What a bucket hands on: the latest right row of all buckets before it, of those that have rows.
    ends = given.withColumn("_bucket", bucket(F.col("_at"))).groupBy(*place).agg(F.max(F.struct("_at", "_right")).alias("_edge"))
    asked = asking.select(*key_names, bucket(F.col("_at")).alias("_bucket")).distinct()
    edges = asked.join(ends, place, "full")
    before = Window.partitionBy(*key_names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*place, F.last("_edge", ignorenulls=True).over(before)["_right"].alias("_beyond"))
    # NULL keys and times meet no bucket here.
    joined = placed.join(carried, place, "left")
    usable = F.col("_at").isNotNull()
    for name in key_names:
        usable &= F.col(name).isNotNull()
    value = F.when(usable, F.coalesce("_near", "_beyond"))
    return joined.select("_left.*", *[value[name].alias(name) for name in values])
