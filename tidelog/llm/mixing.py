"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Each source gets a target number of words: its share by weight, at most `most_repeats`
   times its own size; what a full source cannot take is shared among the others by weight.
2. A fixed number of equal blocks of words is apportioned to sources by highest quotients
   target / (2 s - 1), then each source's blocks to its shards by the shards' sizes.
   A source that blocks are coarse for gets its target to the word and gives it to its shards in
   blocks of one word: one with a target of few blocks, or with a shard so small that its quota,
   rounded to blocks, could pass most_repeats times its size. The other sources share the rest.
3. A shard puts its documents into a seeded order and takes its quota of blocks from a seeded
   start on, round and round: whole passes first, then a run of consecutive blocks.

So each source comes within a block of its target, small and full ones within a word, and a
document is cut only where a run ends.
Shards split a hot source: no task orders more than a shard, and only one sum per shard and
source is apportioned.

Cases: a NULL text has size 0 and nothing is taken of it; a NULL source is a source of its own
and comes last; repeated rows are taken like different ones; an empty table gives no rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.words import count_words, split_words

PRIME = 2**31 - 1
# A target of fewer blocks is met to the word.
LEAST_BLOCKS = 1000


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def weigh_in_turn(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Gives the sources the weights in turn, by code point of their names, NULL last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*(_long(w) for w in weights))
    return sizes.withColumn("weight", table[place % len(weights)])


def set_targets(weighted: DataFrame, most_repeats: int = 3) -> DataFrame:
    """Adds `target`: sizes are shared by weight; no target exceeds most_repeats sizes.

    In the order of capacity per weight the full sources come first; the rest share what is
    left by weight.
    """
    rows = weighted.withColumn("capacity", F.col("source_size") * most_repeats)
    order = Window.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("capacity").over(before), _long(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), _long(0))
    rows = rows.withColumn("level", left / weights)
    # Taking out a full source raises the level of the rest, any other lowers it: the highest
    # level is that of the first source that is not full.
    rows = rows.withColumn("shared", F.max("level").over(whole))
    shared = F.col("shared") * F.col("weight")
    full = F.col("shared").isNull() | (shared > F.col("capacity"))
    target = F.when(full, F.col("capacity").cast("double")).otherwise(shared)
    return rows.select(*weighted.columns, target.cast("double").alias("target"))


def apportion(claims: DataFrame, group: list[str], item: list[str], claim: str, seats: str) -> DataFrame:
    """Sainte-Laguë: adds `quota`, the seats of each item; they add up to the group's seats.

    A divisor that gives all seats lies so near total / seats that each item's number is known
    but for a few; only the quotients of those few are ranked.
    """
    # Without a group all items share one, which Spark would keep in one task anyway.
    whole = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(whole)
    total = F.sum(claim).over(whole)
    rows = claims.select("*", n.alias("_n"), total.cast("double").alias("_total"))
    exact = F.when(F.col("_total") > 0, F.col(claim) * F.col(seats) / F.col("_total")).otherwise(0.0)
    spread = F.when(F.col(seats) > 0, F.col("_n") / (F.col(seats) * 2.0)).otherwise(0.0)
    sure = F.greatest(_long(0), F.floor(exact * (1 - spread) - 1.5))
    most = F.ceil(exact * (1 + 2 * spread) + 1.5)
    rows = rows.select("*", sure.cast("bigint").alias("_sure"), most.cast("bigint").alias("_most"))
    open_seats = F.col(seats) - F.sum("_sure").over(whole)
    rows = rows.select("*", open_seats.alias("_open"))
    seat = F.explode(F.sequence(F.col("_sure") + 1, F.col("_most")))
    quotients = rows.filter(F.col(claim) > 0).select(
        *group, *item, "_open", seat.alias("_seat"), F.col(claim).alias("_claim")
    )
    quotients = quotients.select(
        "*", (F.col("_claim").cast("double") / (F.col("_seat") * 2 - 1)).alias("_quotient")
    )
    order = Window.partitionBy(*group).orderBy(
        F.col("_quotient").desc(), *(F.col(c).asc_nulls_last() for c in item)
    )
    won = quotients.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _open")
    won = won.groupBy(*group, *item).agg(F.count(F.lit(1)).alias("_won"))
    keys = [*group, *item]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    quota = F.col("a._sure") + F.coalesce(F.col("b._won"), _long(0))
    columns = [f"a.{c}" for c in claims.columns]
    return rows.alias("a").join(won.alias("b"), same, "left").select(
        *columns, F.when(F.col(f"a.{claim}") > 0, quota).otherwise(_long(0)).alias("quota")
    )


def _mix_number(number: Column, seed: int) -> Column:
    """A seeded number below PRIME; plain integer steps, the same in any SQL."""
    x = F.pmod(number, _long(PRIME))
    for factor, add in ((48271, seed + 1), (69621, seed + 7)):
        x = F.pmod(x * _long(factor) + _long(add), _long(PRIME))
    return x


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most_repeats: int = 3,
    n_blocks: int = 131072,
    n_shards: int = 64,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_rows: bool = False,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, and what the mix takes of it.

    `passes` is the number of times the whole document is taken; `cuts` are the spans of words
    taken once more. With with_rows, the input row comes along as struct `row`.
    """
    size = count_words(F.col(text_col))
    number = F.coalesce(F.col("id").cast("bigint"), _long(0)) * 31 + F.col("size")
    rows = docs.select(
        *([F.struct("*").alias("row")] if with_rows else []),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
    )
    rows = rows.withColumn("order", _mix_number(number, seed))
    rows = rows.withColumn("shard", F.pmod("order", _long(n_shards)).cast("int"))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    sizes = shards.groupBy("source").agg(
        F.sum("shard_size").alias("source_size"),
        F.min(F.when(F.col("shard_size") > 0, F.col("shard_size"))).alias("least_shard"),
    )
    targets = set_targets(weigh_in_turn(sizes, weights), most_repeats)
    total = F.sum("source_size").over(Window.partitionBy())
    block = F.greatest(_long(1), F.ceil(total / n_blocks))
    targets = targets.select("*", block.alias("block"), total.alias("total"))
    # A quota is its shard's part of the target, rounded by about half a block; here a whole one
    # has to fit below the most a shard can give.
    room = F.col("least_shard") * (F.col("source_size") * most_repeats - F.col("target"))
    coarse = (F.col("target") < F.col("block") * LEAST_BLOCKS) | (room < F.col("block") * F.col("source_size"))
    by_word = (F.col("block") > 1) & coarse
    words = F.least(F.round("target").cast("bigint"), F.col("source_size") * most_repeats)
    targets = targets.select("*", F.when(by_word, words).alias("words"))
    rest = F.greatest(_long(0), F.col("total") - F.coalesce(F.sum("words").over(Window.partitionBy()), _long(0)))
    claim = F.when(F.col("words").isNull(), F.col("target")).otherwise(0.0)
    targets = targets.select("*", claim.alias("claim"), F.floor(rest / F.col("block")).alias("blocks"))
    sources = apportion(targets, [], ["source"], "claim", "blocks")
    sources = sources.withColumn("source_quota", F.coalesce("words", "quota"))
    sources = sources.withColumn("block", F.when(F.col("words").isNull(), F.col("block")).otherwise(_long(1)))
    claims = shards.alias("h").join(
        sources.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))
    ).select("h.source", "shard", "shard_size", "source_size", "target", "block", "source_quota")
    quotas = apportion(claims, ["source"], ["shard"], "shard_size", "source_quota")
    most = F.col("shard_size") * most_repeats
    words = F.least(F.col("quota") * F.col("block"), most)
    start = F.pmod(F.col("shard") * _long(7919) + _long(seed * 104729), F.greatest(F.col("shard_size"), _long(1)))
    plans = quotas.select(
        F.col("source").alias("plan_source"),
        F.col("shard").alias("plan_shard"),
        "shard_size",
        "source_size",
        "target",
        F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("bigint").alias("passes"),
        F.when(F.col("shard_size") > 0, F.pmod(words, F.col("shard_size"))).otherwise(0).cast("bigint").alias("run"),
        (F.floor(start / F.col("block")) * F.col("block")).cast("bigint").alias("run_start"),
    )
    # Rows that agree in all of this are alike but for their text, which then decides.
    ties = ["order", F.col("id").asc_nulls_last(), "size"]
    if with_rows:
        ties.append(F.xxhash64("row"))
    before = Window.partitionBy("source", "shard").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("begin", F.coalesce(F.sum("size").over(before), _long(0)))
    placed = placed.join(
        plans,
        F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("shard") == F.col("plan_shard")),
    )
    end = F.col("begin") + F.col("size")
    stop = F.col("run_start") + F.col("run")
    # The run goes round: what passes the shard's end goes on at its beginning.
    first = F.struct(
        F.greatest("begin", "run_start").alias("a"), F.least(end, stop, F.col("shard_size")).alias("b")
    )
    second = F.struct(F.col("begin").alias("a"), F.least(end, stop - F.col("shard_size")).alias("b"))
    spans = F.transform(
        F.filter(F.array(second, first), lambda s: s["b"] > s["a"]),
        lambda s: F.struct((s["a"] - F.col("begin")).alias("from_word"), (s["b"] - F.col("begin")).alias("to_word")),
    )
    placed = placed.withColumn("cuts", spans)
    once_more = F.aggregate("cuts", _long(0), lambda t, s: t + s["to_word"] - s["from_word"])
    return placed.select(
        *(["row"] if with_rows else []),
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + once_more).alias("taken"),
        "passes",
        "cuts",
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns.

    A document at the end of a run appears with the words taken of it, joined by spaces; if
    chars_col is given, it is set to the new length.
    """
    mixed = mix_sources(docs, text_col=text_col, with_rows=True, **options)
    own = F.array_repeat(F.struct(_long(0).alias("from_word"), F.col("size").alias("to_word")), F.col("passes").cast("int"))
    rows = mixed.select("row", "size", F.explode(F.concat(own, F.col("cuts"))).alias("span"))
    text = F.col(f"row.{text_col}")
    part = F.array_join(
        F.slice(
            split_words(text),
            (F.col("span.from_word") + 1).cast("int"),
            (F.col("span.to_word") - F.col("span.from_word")).cast("int"),
        ),
        " ",
    )
    is_whole = F.col("span.to_word") - F.col("span.from_word") == F.col("size")
    rows = rows.withColumn("new_text", F.when(is_whole, text).otherwise(part))
    rows = rows.filter("size > 0")
    columns = []
    for name in docs.columns:
        if name == text_col:
            columns.append(F.col("new_text").alias(name))
        elif name == chars_col:
            columns.append(F.length("new_text").cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"row.{name}"))
    return rows.select(*columns)
