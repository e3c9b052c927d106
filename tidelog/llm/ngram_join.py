"""Exact Jaccard join of documents on word n-grams by token-combination prefixes.

Texts with equal n-gram sets form a class; everything below works on one set per class. Let a set
of n tokens have at most e = n - ceil(t n) tokens outside any set it is linked with.

1. Extended prefixes of the sets in an arbitrary order, e + l tokens of each: linked sets share
   l of them. One shuffle of these finds the few classes of which enough tokens occur elsewhere;
   only their texts are read again.
2. The tokens of those sets are counted. In the order of rising counts, the prefix of a set
   indexes rare tokens alone and frequent ones in combinations of k = 2. Frequent tokens fall into
   g groups by their hash, and only two of the same group are combined. The prefix is extended until
   singles, and frequent tokens less g, number e + 1: linked sets then share a rare token, or g + 1
   frequent ones, of which two are in one group. So they share an index entry, and a set of n tokens
   has about as many entries as e, not its square. Sets of about one size have the same g;
   a set makes the entries of every size that a set linked with it may have.
3. Short lists of the index give all their pairs. In a long list all sets are compared with the
   list's most typical set, its centre c. Sets linked with c are in one component already. For a
   set a not linked with c, a link between a and b needs their differences from c to overlap by
   more than half of b's; so b looks up the rarest half of its difference among the whole
   differences of all such a. Only what meets there is compared.
4. Links are verified on whole sets; components follow from star operations.

So long lists cost as much as they have members, not pairs, and no link between different texts
is lost unless its ends are in one component anyway.

Cases: NULL and empty texts, and texts without words, have empty sets and are linked with nothing;
fewer words than n make one token. Equal texts are linked. A row whose id is NULL takes part; its
component is the smallest id that is not NULL, if there is one. Extra columns are not looked at.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm import components
from tidelog.llm.shingles import in_sets, scatter, set_key
from tidelog.llm.words import count_words, text_or_empty
from tidelog.session import work_folder

_U = np.uint64
# Bits of the filter that thins out texts before the second reading; more texts than fit only
# make it let more through.
FILTER_BITS = 1 << 23
PAGE_BITS = 32768


@dataclass(frozen=True)
class Join:
    """Two sets are linked if bottom * |intersection| >= top * |union|."""

    width: int = 5
    top: int = 80
    bottom: int = 100
    # Tokens of more sets than this are indexed in pairs, in sets of these sizes.
    frequent: int = 200
    least_paired: int = 10
    most_paired: int = 300
    # Lists up to this length give all pairs.
    short_list: int = 32

    def bands(self) -> list[tuple[int, int, int]]:
        """Least and most size of sets whose frequent tokens are combined in the same groups, and
        the number of these; linked sets of a band have more tokens in common than groups."""
        found, low = [], self.least_paired
        while low <= self.most_paired:
            high = min(4 * low - 1, self.most_paired)
            groups = min(int(self.outside(2 * low)) // 2, int(self.least_overlap(low)) - 1)
            found.append((low, high, max(1, groups)))
            low = high + 1
        return found

    def least_overlap(self, n):
        """Tokens that a linked set shares with one of n tokens, at least."""
        return -(-n * self.top // self.bottom)

    def outside(self, n):
        return n - self.least_overlap(n)

    def extra(self, n):
        """Length of the extension of the arbitrary prefix; grows with n."""
        return np.maximum(1, n // 10)

    def most_difference(self, total):
        """Largest symmetric difference of linked sets that have `total` tokens together."""
        return (self.bottom - self.top) * total // (self.bottom + self.top)

    def linked(self, overlap: int, n: int, m: int) -> bool:
        return self.bottom * overlap >= self.top * (n + m - overlap)


def _written(df: DataFrame, purpose: str) -> DataFrame:
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _signed(tokens: np.ndarray) -> pa.Array:
    return pa.array(tokens.view(np.int64))


def _members(join: Join):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in in_sets(batches, join.width):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_key"),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                ],
                ["id", "text_key", "cid", "n"],
            )

    return run


def _extended_prefixes(join: Join):
    """Tokens of the arbitrary prefixes (lowest hashes first), each at most once per batch.

    A token of several sets of the batch is sent without a set, and its sets are credited at
    once, in rows whose token is one of their own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in in_sets(batches, join.width):
            by_key = {set_key(s): s for s in sets if len(s)}
            keys = np.array(list(by_key), np.int64)
            if not len(keys):
                continue
            lengths = np.array([len(s) for s in by_key.values()])
            taken = np.minimum(lengths, join.outside(lengths) + join.extra(lengths))
            tokens = np.concatenate([s[:k] for s, k in zip(by_key.values(), taken, strict=True)])
            owner = np.repeat(np.arange(len(keys)), taken)
            distinct, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
            single = count[inverse] == 1
            credit = np.bincount(owner[~single], minlength=len(keys))
            credited = np.flatnonzero(credit)
            several = distinct[count > 1]
            with np.errstate(over="ignore"):
                own = scatter(keys[credited].view(_U) ^ _U(0x5851F42D4C957F2D))
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate([tokens[single], several, own])),
                    pa.array(
                        np.concatenate([keys[owner[single]], np.zeros(len(several), np.int64), keys[credited]]),
                        mask=np.concatenate(
                            [np.zeros(single.sum(), bool), np.ones(len(several), bool), np.zeros(len(own), bool)]
                        ),
                    ),
                    pa.array(
                        np.concatenate([np.zeros(single.sum() + len(several), np.int32), credit[credited].astype(np.int32)])
                    ),
                ],
                ["token", "cid", "credit"],
            )

    return run


def _likely(join: Join, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes of whose extended prefix enough tokens occur in other classes."""
    tokens = texts.mapInArrow(_extended_prefixes(join), "token bigint, cid bigint, credit int")
    # A token comes once per batch at most, so that no group is as large as the table.
    same = Window.partitionBy("token")
    own = F.col("credit") == 0
    shared = F.max(F.when(own & F.col("cid").isNull(), 1)).over(same).isNotNull() | (
        F.max(F.when(own, F.col("cid"))).over(same) != F.min(F.when(own, F.col("cid"))).over(same)
    )
    credits = tokens.select("cid", F.when(own, shared.cast("int")).otherwise(F.col("credit")).alias("credit"))
    sums = credits.filter("cid is not null and credit > 0").groupBy("cid").agg(F.sum("credit").alias("credit"))
    least = F.ceil(F.col("n") * F.lit(join.top) / F.lit(join.bottom))
    needed = F.greatest(F.lit(1), F.floor(least / 10))
    return classes.join(sums, "cid").filter(F.col("credit") >= needed).select("cid", "text_key", "n")


def _through_filter(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts whose key may be among the wanted ones, without moving the others.

    The wanted keys set bits of a filter of fixed size, a megabyte, which every task gets.
    """
    bit = F.pmod(F.xxhash64("text_key", F.lit(3)), F.lit(FILTER_BITS).cast("bigint"))
    pages = (
        wanted.select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / PAGE_BITS).alias("page"))
        .agg(F.expr(f"bitmap_construct_agg(bit % {PAGE_BITS})").alias("page_bits"))
    )
    rows = texts.withColumn("bit", bit).withColumn("page", F.floor(F.col("bit") / PAGE_BITS))
    place = F.col("bit") % PAGE_BITS
    byte = F.conv(F.hex(F.substring("page_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(pages), "page").filter(is_set).drop("bit", "page", "page_bits")


def _whole_sets(join: Join):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in in_sets(batches, join.width):
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["cid", "n", "tokens"],
            )

    return run


def _explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("cid").to_numpy()
        sets = [np.frombuffer(b, _U) for b in batch.column("tokens").to_pylist()]
        if sets:
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(sets)), pa.array(np.repeat(keys, [len(s) for s in sets]))], ["token", "cid"]
            )


def _entries(join: Join):
    """Index entries of each set, from its tokens that other sets have too.

    Also the set itself: tokens in order of hash with their counts, for comparisons.
    """

    def entry(*tokens: int) -> int:
        with np.errstate(over="ignore"):
            mixed = _U(len(tokens))
            for token in tokens:
                mixed = scatter(np.array([mixed * _U(0xD6E8FEB86659FD93) + _U(token)], _U))[0]
        return int(mixed.astype(np.int64))

    bands = join.bands()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ends = batch.column("shared").offsets.to_numpy()
            values = batch.column("shared").values
            all_tokens = values.field("token").to_numpy().view(_U)
            all_counts = values.field("n_sets").to_numpy()
            numbers = zip(batch.column("cid").to_pylist(), batch.column("n").to_pylist(), strict=True)
            for row, (cid, n) in enumerate(numbers):
                own = slice(ends[row], ends[row + 1])
                tokens, counts = all_tokens[own], all_counts[own]
                order = np.lexsort((tokens, counts))
                tokens, counts = tokens[order], counts[order]
                need = join.outside(n) + 1 - (n - len(tokens))
                if need <= 0:
                    continue
                n_rare = int((counts <= join.frequent).sum())
                found = [entry(t) for t in tokens[: min(need, n_rare)].tolist()]
                need -= n_rare
                if need > 0:
                    # Sizes of sets that this one may be linked with.
                    smallest, largest = join.least_overlap(n), n * join.bottom // join.top
                    combined = set()
                    for low, high, groups in bands:
                        if smallest <= high and low <= largest:
                            taken = tokens[n_rare : n_rare + need + groups]
                            group = taken % _U(groups)
                            for g in range(groups):
                                combined.update(combinations(taken[group == g].tolist(), 2))
                    found += [entry(a, b) for a, b in sorted(combined)]
                    if smallest < join.least_paired or largest > join.most_paired:
                        found += [entry(t) for t in tokens[n_rare : n_rare + need].tolist()]
                by_hash = np.argsort(tokens)
                out.append(
                    {
                        "cid": cid,
                        "n": n,
                        "typical": float(counts.sum()) / n,
                        "entries": found,
                        "tokens": tokens[by_hash].tobytes(),
                        "counts": counts[by_hash].astype("<i8").tobytes(),
                    }
                )
            schema = pa.schema(
                [
                    ("cid", pa.int64()),
                    ("n", pa.int64()),
                    ("typical", pa.float64()),
                    ("entries", pa.list_(pa.int64())),
                    ("tokens", pa.binary()),
                    ("counts", pa.binary()),
                ]
            )
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _compare(join: Join):
    """Pairs of sets that are linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            columns = (batch.column(c).to_pylist() for c in ("n_a", "tokens_a", "n_b", "tokens_b"))
            for n, left, m, right in zip(*columns, strict=True):
                overlap = len(np.intersect1d(np.frombuffer(left, _U), np.frombuffer(right, _U), assume_unique=True))
                kept.append(join.linked(overlap, n, m))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(kept, pa.bool_())], ["a", "b", "linked"]
            )

    return run


def _differences(join: Join):
    """Compares sets (a) with the centre of a list (b) and splits up their differences.

    kind 0: a is linked with the centre. kind 1: a token of the whole difference of a set that is
    not. kind 2: a token that any set looks up, so that it meets each such set it is linked with.
    With `size` tokens in the difference, `left` is how many of them can still be shared when
    this token is the first that is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, centres, sets, tokens, numbers, sizes, lefts = [], [], [], [], [], [], []
            columns = (
                batch.column(c).to_pylist()
                for c in ("a", "n_a", "tokens_a", "counts_a", "b", "n_b", "tokens_b", "counts_b", "n_list")
            )
            for a, n, own, own_counts, c, m, other, other_counts, n_list in zip(*columns, strict=True):
                x, y = np.frombuffer(own, _U), np.frombuffer(other, _U)
                new = ~np.isin(x, y, assume_unique=True)
                gone = ~np.isin(y, x, assume_unique=True)
                overlap = len(x) - int(new.sum())
                size = n + m - 2 * overlap
                is_linked = join.linked(overlap, n, m)
                # Tokens that no other set has are known by their number alone, and meet nothing.
                alone = n - len(x)
                rarity = np.concatenate(
                    [
                        np.frombuffer(own_counts, "<i8")[new],
                        np.maximum(1, n_list - np.frombuffer(other_counts, "<i8")[gone]),
                    ]
                )
                difference = np.concatenate([x[new], y[gone]])
                # Tokens that only the centre has are missing from all others: they meet in them.
                centre_alone = m - len(y)
                # With D the difference of this set and E that of one apart from the centre,
                # D \\ E has (|D| - |E| + |D ^ E|) / 2 tokens. Were the two linked, |D ^ E| would
                # exceed |E| by less than the bounds on differences, of this set and of the
                # centre, are apart.
                bounds_apart = -((join.bottom - join.top) * (m - n) // (join.bottom + join.top))
                reach = (size + bounds_apart - 1) // 2
                look_up = max(0, reach + 1 - alone)
                order = np.argsort(rarity, kind="stable")
                chosen = difference[order[:look_up]].view(np.int64).tolist()
                everything = difference.view(np.int64).tolist()
                if look_up > len(difference) and centre_alone:
                    chosen.append(None)
                if centre_alone:
                    everything.append(None)
                if is_linked:
                    rows = [(0, None, 0)]
                else:
                    rows = [(1, token, size - alone) for token in everything]
                rows += [(2, token, size - alone - place) for place, token in enumerate(chosen)]
                for kind, token, left in rows:
                    kinds.append(kind)
                    tokens.append(token)
                    lefts.append(left)
                centres += [c] * len(rows)
                sets += [a] * len(rows)
                numbers += [n] * len(rows)
                sizes += [size] * len(rows)
            values = (kinds, centres, sets, tokens, numbers, sizes, lefts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in values], ["kind", "centre", "cid", "token", "n", "size", "left"]
            )

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, counts: bool) -> DataFrame:
    """Puts the sets of both ends beside pairs (a, b)."""
    for end in ("a", "b"):
        own = [F.col("cid").alias(end), F.col("n").alias(f"n_{end}"), F.col("tokens").alias(f"tokens_{end}")]
        if counts:
            own.append(F.col("counts").alias(f"counts_{end}"))
        pairs = pairs.join(sets.select(*own), end)
    return pairs


def class_links(join: Join, spark: SparkSession, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that connect what is linked; see the top of the module."""
    likely = _written(_likely(join, texts, classes), "likely")
    wanted = _through_filter(texts.select("text_key", "text"), likely)
    wanted = wanted.groupBy("text_key").agg(F.first("text").alias("text")).join(
        likely.select("text_key", "cid"), "text_key"
    )
    whole = _written(wanted.select("cid", "text").mapInArrow(_whole_sets(join), "cid bigint, n bigint, tokens binary"), "sets")
    tokens = whole.select("cid", "tokens").mapInArrow(_explode, "token bigint, cid bigint")
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_sets")).filter("n_sets > 1")
    shared = tokens.join(counted, "token").groupBy("cid").agg(F.collect_list(F.struct("token", "n_sets")).alias("shared"))
    indexed = whole.select("cid", "n").join(shared, "cid").mapInArrow(
        _entries(join),
        "cid bigint, n bigint, typical double, entries array<bigint>, tokens binary, counts binary",
    )
    indexed = _written(indexed, "index")
    sets = indexed.select("cid", "n", "tokens", "counts")
    entries = indexed.select("cid", "typical", F.explode("entries").alias("entry"))
    lists = entries.groupBy("entry").agg(
        F.count(F.lit(1)).alias("n_list"), F.max(F.struct("typical", "cid"))["cid"].alias("centre")
    )
    listed = entries.select("entry", "cid").join(lists.filter("n_list > 1"), "entry")
    short = listed.filter(F.col("n_list") <= join.short_list).groupBy("entry").agg(
        F.sort_array(F.collect_set("cid")).alias("ids")
    )
    ids = F.col("ids")
    pairs = F.flatten(
        F.transform(
            ids,
            lambda x, i: F.transform(
                F.slice(ids, i + 2, F.size(ids)), lambda y: F.struct(x.alias("a"), y.alias("b"))
            ),
        )
    )
    near = short.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    central = (
        listed.filter((F.col("n_list") > join.short_list) & (F.col("cid") != F.col("centre")))
        .groupBy(F.col("cid").alias("a"), F.col("centre").alias("b"))
        .agg(F.max("n_list").alias("n_list"))
    )
    split = _with_sets(central, sets, counts=True).mapInArrow(
        _differences(join),
        "kind bigint, centre bigint, cid bigint, token bigint, n bigint, size bigint, left bigint",
    )
    split = _written(split, "differences")
    apart = split.filter("kind = 1").withColumnRenamed("cid", "x")
    asks = split.filter("kind = 2").withColumnRenamed("cid", "y")
    # Linked sets share so much of their differences that it must still be there at the first
    # token they meet in.
    most = F.floor((F.col("l.n") + F.col("r.n")) * (join.bottom - join.top) / (join.bottom + join.top))
    same = [
        F.col("l.centre") == F.col("r.centre"),
        F.col("l.token").eqNullSafe(F.col("r.token")),
        F.col("x") != F.col("y"),
        2 * F.least("l.left", "r.left") >= F.col("l.size") + F.col("r.size") - most,
    ]
    met = apart.alias("l").join(asks.alias("r"), same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    compared = _with_sets(near.union(met).distinct(), sets, counts=False).select(
        "a", "n_a", "tokens_a", "b", "n_b", "tokens_b"
    )
    verified = compared.mapInArrow(_compare(join), "a bigint, b bigint, linked boolean")
    centred = split.filter("kind = 0").select(F.col("cid").alias("a"), F.col("centre").alias("b"))
    return verified.filter("linked").select("a", "b").union(centred)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_or_empty(F.col(text_col))).alias("text_key"),
        F.col(text_col).alias("text"),
    )


def _grouped(texts: DataFrame, join: Join) -> DataFrame:
    """Each row's id, text_key and number n of tokens, with the root of its component, its smallest
    id and that of its class; the last three are NULL for empty sets."""
    spark = texts.sparkSession
    kind = texts.schema["id"].dataType.simpleString()
    members = _written(
        texts.mapInArrow(_members(join), f"id {kind}, text_key bigint, cid bigint, n bigint"), "members"
    )
    classes = members.filter("cid is not null").groupBy("cid").agg(
        F.min("id").alias("class_id"), F.min("text_key").alias("text_key"), F.max("n").alias("n")
    )
    links = class_links(join, spark, texts, classes.select("cid", "text_key", "n"))
    roots = components.components(links)
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("cid", "class_id", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "root").withColumnRenamed("cid", "key")
    # Rows without a set get keys of their own, so that they do not meet in one task.
    key = F.coalesce("cid", F.xxhash64("id", F.lit(1)))
    rows = members.select("id", "text_key", "n", "cid", key.alias("key")).join(named, "key", "left")
    found = [F.when(F.col("cid").isNotNull(), F.col(c)).alias(c) for c in ("root", "class_id", "component_id")]
    return rows.select("id", "text_key", "n", *found)


def jaccard_components(
    docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_shingles, class_id and component_id.

    class_id is the smallest id of the documents with the same set, component_id the smallest id
    that can be reached by links.
    """
    return _grouped(_texts(docs, id_col, text_col), join).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def one_of_each_component(
    docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without those that another of their component stands for.

    The one with the smallest id stays, once; documents with empty sets all stay.
    """
    grouped = _grouped(_texts(docs, id_col, text_col), join)
    chosen = grouped.filter("root is not null").groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("first"))
    chosen = chosen.select("first.id", "first.text_key")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_or_empty(F.col(text_col))).alias("text_key"),
        (count_words(F.col(text_col)) == 0).alias("is_empty"),
    )
    # Rows that agree in id and text: one of them is enough, before anything is moved.
    same = Window.partitionBy("id", "text_key").orderBy(F.xxhash64("row"))
    single = rows.filter(~F.col("is_empty")).withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    both = F.col("s.id").eqNullSafe(F.col("c.id")) & (F.col("s.text_key") == F.col("c.text_key"))
    kept = single.alias("s").join(chosen.alias("c"), both, "left_semi").select("row")
    return kept.union(rows.filter("is_empty").select("row")).select("row.*")
