"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Rows are numbered from 0 in the order of (id, checksum of the text, size). A keyed Feistel
network permutes the numbers below the next power of two; a number that lands outside the table
walks on through the network until it is inside. The permuted number gives the shard (remainder)
and the slot (quotient), so the shards' counts differ by one at most, and a row's place can be
computed from its number, the number of rows and the seed alone.

Cases: a NULL text has no bytes and checksum 0; NULL ids come first. Repeated rows are counted
before they are sorted and get consecutive numbers. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.words import text_or_empty, utf8_bytes
from tidelog.session import work_folder

ROUNDS = 6
OVERHEAD_BYTES = 8
# A step leaves the table with a chance below 1/2, so that this many are never reached.
MOST_STEPS = 256
LOW_31 = 2**31 - 1
# Odd multipliers of a 32-bit finaliser.
MULTIPLIERS = (0x45D9F3B, 0x119DE1F3)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def network(n_rows: int, seed: int) -> list[tuple[int, int, int]]:
    """Key, width of the left and of the right part for each round; the widths change places."""
    bits = max(2, (n_rows - 1).bit_length())
    left, right = bits // 2, bits - bits // 2
    rounds = []
    for r in range(ROUNDS):
        rounds.append(((seed * 2654435761 + 40503 * (r + 1) ** 3) & LOW_31, left, right))
        left, right = right, left
    return rounds


def _scramble(value: Column, key: Column) -> Column:
    """A hash below 2**31 of a number below 2**31; no product exceeds 63 bits."""
    steps = F.array(*(_long(m) for m in MULTIPLIERS), _long(1))
    start = (value + key).bitwiseAND(_long(LOW_31))
    return F.aggregate(
        steps,
        start,
        lambda v, m: (v.bitwiseXOR(F.shiftright(v, 14)) * m).bitwiseAND(_long(LOW_31)),
    )


def _low(value: Column, bits: Column) -> Column:
    return value.bitwiseAND(F.call_function("shiftleft", _long(1), bits) - 1)


def _permute(number: Column, rounds: list[tuple[int, int, int]]) -> Column:
    steps = F.array(
        *(
            F.struct(_long(k).alias("key"), F.lit(a).alias("left"), F.lit(b).alias("right"))
            for k, a, b in rounds
        )
    )

    def one(v: Column, s: Column) -> Column:
        right = _low(v, s["right"])
        left = F.call_function("shiftright", v, s["right"])
        mixed = left.bitwiseXOR(_low(_scramble(right, s["key"]), s["left"]))
        return F.call_function("shiftleft", right, s["left"]).bitwiseOR(mixed)

    return F.aggregate(steps, number, one)


def permuted(number: Column, n_rows: int, seed: int) -> Column:
    """The place of a row number in the shuffled order of a table of n_rows rows."""
    rounds = network(n_rows, seed)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_STEPS)),
        _permute(number, rounds),
        lambda v, _: F.when(v < n_rows, v).otherwise(_permute(v, rounds)),
    )
    return walked


def _numbered(spark: SparkSession, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct key with `first`, the number of its first row, and `copies`.

    The sorted keys are written once, with an id made of the partition and the place in it, so
    that no task ever counts more than its own range; only one sum per range meets in a task.
    """
    folder = work_folder(spark, "row-numbers")
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    (
        counted.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.monotonically_increasing_id().alias("place"))
        .write.parquet(folder)
    )
    rows = spark.read.parquet(folder).withColumn("range", F.shiftright("place", 33))
    sums = rows.groupBy("range").agg(F.sum("copies").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    before = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("copies").over(before), F.lit(0))
    return (
        rows.withColumn("inside", inside)
        .join(offsets, "range")
        .select(*keys, "copies", (F.col("offset") + F.col("inside")).alias("first"))
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("key_id"),
        F.crc32(F.encode(text, "UTF-8")).alias("key_crc"),
        (utf8_bytes(F.col(text_col)) + OVERHEAD_BYTES).alias("key_size"),
    )


KEYS = ["key_id", "key_crc", "key_size"]


def _places(docs: DataFrame, n_shards: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Key, number of the copy, shard and slot of each row."""
    spark = docs.sparkSession
    numbered = _numbered(spark, _keyed(docs, id_col, text_col), KEYS)
    total = numbered.agg(F.sum("copies")).first()[0] or 0
    rows = numbered.select(
        *KEYS, "first", F.explode(F.sequence(_long(0), F.col("copies") - 1)).alias("copy")
    ).select(*KEYS, "copy", permuted(F.col("first") + F.col("copy"), max(total, 1), seed).alias("place"))
    return rows.select(
        *KEYS,
        "copy",
        F.pmod("place", _long(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).cast("bigint").alias("slot"),
    )


def shard_rows(
    docs: DataFrame,
    n_shards: int,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot and grown_shard (NULL)."""
    return _places(docs, n_shards, seed, id_col, text_col).select(
        F.col("key_id").alias(id_col),
        F.col("key_size").alias("size"),
        F.col("key_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame,
    folder: str,
    n_shards: int,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the documents as one directory per shard; `slot` is their order within it."""
    places = _places(docs, n_shards, seed, id_col, text_col)
    text = text_or_empty(F.col(text_col))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("key_id"),
        F.crc32(F.encode(text, "UTF-8")).alias("key_crc"),
        (utf8_bytes(F.col(text_col)) + OVERHEAD_BYTES).alias("key_size"),
    )
    # Rows of one key are told apart by what else they hold.
    copies = Window.partitionBy(*KEYS).orderBy(F.xxhash64("row"))
    rows = rows.withColumn("copy", (F.row_number().over(copies) - 1).cast("bigint"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*KEYS, "copy")]
    joined = rows.alias("r").join(places.alias("p"), same)
    joined.select("r.row", "p.shard", "p.slot").write.partitionBy("shard").parquet(folder)
