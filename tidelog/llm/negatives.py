"""Hard negatives by candidate lists that the anchors of a cluster share, walked to a certified end.

Anchors are clustered by direction. For a cluster with centre c whose members lie within the
angle r of it, no member u can have a larger inner product with a candidate v than

    |u| |v| cos(max(0, angle(v, c) - r)),

so that |v| cos(...) orders the candidates once for all members. The list of a cluster is sorted by it
over the whole cluster, by ranges, and cut into segments of SEGMENT rows, so neither a list nor a cluster
ever meets in one task: members are dealt out in parts, and a task walks one segment for one part.
A member stops where its bound falls below the score it still needs; ties go on.

1. The first walk finds each anchor's positives, its best rows of the same label. It needs the
   last of them.
2. Every positive gives a window of scores for its negatives. The second walk finds the best rows of
   other labels in each window, and needs the last of them or the window's lower end.

Each walk goes through the lists in a few rounds, best segments first (STEPS are shares of a
list). After each round the best so far are merged, and what an anchor needs decides
which of the next segments it still looks at: for vectors with structure most anchors end in the first rounds; for those
without any the bounds exclude nothing and all is compared, which is exact as well. The sorted lists
and each round's best are written below the shared folder, so that lost executors cost only their own tasks.

Centres are fitted by spherical k-means to at most SAMPLE anchors; only the order of the
lists depends on them, results never do. Components are multiplied and floored; inner products are
exact integers.

Cases: rows whose id, label or vector is NULL, empty, or holds components that are NULL or not finite (or
would not be after the multiplication) take no part, nor do vectors of another length than most (of equally
frequent lengths the smaller counts). "Other rows" of an anchor are those with another id. Rows that are
repeated count as often as they come, as anchors as well. Ties go to the smaller id. Vectors that
become zero score 0. Scores beyond the range of a bigint are set to its ends. A positive that
scores below 0 has no negatives, as its window is empty. An empty table gives no rows.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import work_folder

# Rows of a segment, rows compared at once, members of a part, anchors the centres are fitted to.
SEGMENT = 2048
BLOCK = 256
PART = 1024
SAMPLE = 4096
# Members a cluster should have, most clusters, and the share of a list after each round.
MEMBERS = 128
MOST_CLUSTERS = 64
STEPS = (1 / 32, 1 / 4, 1.0)
LIMIT = 2**63 - 1
EXACT = float(2**53)


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the per cent of a positive's score that a negative has."""

    n_positives: int = 5
    n_negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """Whole numbers, as doubles."""
    return np.floor(values.astype(np.float64) * scale)


def packed(vectors: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes: two for each where they suffice, else eight."""
    small = (np.abs(vectors) < 2**15).all(axis=1)
    return [(v.astype("<i2") if s else v.astype("<f8")).tobytes() for v, s in zip(vectors, small, strict=True)]


def unpacked(blobs: list[bytes], dimension: int) -> np.ndarray:
    rows = [np.frombuffer(b, "<i2" if len(b) == 2 * dimension else "<f8") for b in blobs]
    return np.array(rows, np.float64).reshape(len(rows), dimension)


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, a little too large rather than too small."""
    with np.errstate(over="ignore"):
        return np.sqrt((vectors * vectors).sum(axis=1)) * (1 + 1e-12)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows as exact integers."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), np.int64)
    with np.errstate(over="ignore"):
        most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1]
    if most < EXACT:
        return (left @ right.T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in rows.tolist()] for rows in (left, right))
    whole = [[max(-LIMIT, min(LIMIT, sum(map(int.__mul__, x, y)))) for y in b] for x in a]
    return np.array(whole, np.int64)


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1), axis=1, keepdims=True)
    unit = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1) / np.maximum(size, 1e-300)
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def fit_centres(vectors: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of a spherical k-means."""
    rng = np.random.default_rng(seed)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    centres = unit[rng.choice(len(unit), min(n, len(unit)), replace=False)]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            total = unit[nearest == k].sum(axis=0)
            size = np.linalg.norm(total)
            if size > 1e-9:
                centres[k] = total / size
    return centres


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dimension)


def _placed(centres: np.ndarray, dimension: int, scale: int):
    """Anchors with their nearest centre and the angle to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = quantised(_matrix(batch.column("values"), dimension), scale)
            angles = _angles(vectors, centres)
            cluster = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "id", "label")),
                    pa.array(packed(vectors), pa.binary()),
                    pa.array(norms(vectors)),
                    pa.array(cluster, pa.int32()),
                    pa.array(angles[np.arange(len(vectors)), cluster]),
                ],
                ["row", "id", "label", "vector", "norm", "cluster", "angle"],
            )

    return run


def _listed(centres: np.ndarray, radii: dict[int, float], dimension: int, scale: int):
    """Every row once for each cluster, with the bound for members of length 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                vectors = quantised(_matrix(batch.column("values"), dimension), scale)
                blobs = pa.array(packed(vectors), pa.binary())
                sizes, angles = norms(vectors), _angles(vectors, centres)
                for cluster, radius in radii.items():
                    apart = np.maximum(0, angles[:, cluster] - radius - 1e-6)
                    bound = sizes * (np.cos(apart) + 1e-9)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(batch.num_rows, cluster, np.int32)),
                            pa.array(np.nan_to_num(bound, nan=np.inf)),
                            *(batch.column(c) for c in ("row", "id", "label")),
                            blobs,
                        ],
                        ["cluster", "bound", "row", "id", "label", "vector"],
                    )

    return run


def _walk(dimension: int, kept: int, same_label: bool, schema: pa.Schema):
    """Best rows of a segment for each member of a part, by window.

    A member has windows of scores [low, high], and for each what it still needs; without any
    (the first walk) there is one window of all scores.
    """

    def run(key, listed: pa.Table, members: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], [], []]
        if listed.num_rows and members.num_rows:
            listed = listed.sort_by([("bound", "descending"), ("id", "ascending"), ("row", "ascending")])
            v = unpacked(listed["vector"].to_pylist(), dimension)
            ids, rows, labels, bounds = (listed[c].to_numpy() for c in ("id", "row", "label", "bound"))
            u = unpacked(members["vector"].to_pylist(), dimension)
            sizes, own_ids, own_labels = (members[c].to_numpy() for c in ("norm", "id", "label"))
            lows, highs, needs = ([np.array(w, t) for w in members[c].to_pylist()] for c, t in (("lows", np.int64), ("highs", np.int64), ("needs", np.float64)))
            best = [[(np.empty(0, np.int64),) * 3 for _ in w] for w in lows]
            walking = np.arange(len(u))
            for begin in range(0, len(v), BLOCK):
                least = np.array([needs[m].min(initial=np.inf) for m in walking])
                walking = walking[sizes[walking] * bounds[begin] >= least]
                if not len(walking):
                    break
                some = slice(begin, begin + BLOCK)
                product = scores(u[walking], v[some])
                wanted = (labels[some][None, :] == own_labels[walking][:, None]) == same_label
                wanted &= ids[some][None, :] != own_ids[walking][:, None]
                for m, points, fits in zip(walking, product, wanted, strict=True):
                    for w in range(len(lows[m])):
                        chosen = np.flatnonzero(fits & (points >= lows[m][w]) & (points <= highs[m][w]))
                        if not len(chosen):
                            continue
                        merged = [
                            np.concatenate([old, new])
                            for old, new in zip(best[m][w], (points[chosen], ids[some][chosen], rows[some][chosen]), strict=True)
                        ]
                        order = np.lexsort((merged[2], merged[1], -merged[0]))[:kept]
                        best[m][w] = tuple(x[order] for x in merged)
                        if len(order) == kept:
                            needs[m][w] = max(needs[m][w], best[m][w][0][-1])
            own_rows = members["row"].to_numpy()
            for m, windows in enumerate(best):
                for w, (points, other_ids, other_rows) in enumerate(windows):
                    n = len(points)
                    for target, values in zip(found, ([own_rows[m]] * n, [w] * n, points, other_ids, other_rows), strict=True):
                        target.extend(values)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

    return run


def _usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    values = F.col(vector_col)
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), values.alias("values"))
    kept = kept.filter("id is not null and label is not null and size(values) > 0")
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    return kept.filter(~bad).withColumn("length", F.size("values"))


def _stored(spark: SparkSession, rows: DataFrame, purpose: str) -> DataFrame:
    folder = work_folder(spark, f"negatives-{purpose}")
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


def _best(found: DataFrame, kept: int) -> DataFrame:
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "other_id", "other_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept)


class _Lists:
    """The sorted lists of all clusters, and the walks over them."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, centres: np.ndarray, dimension: int, scale: int):
        self.spark, self.dimension = rows.sparkSession, dimension
        # One row per cluster, at most MOST_CLUSTERS.
        clusters = anchors.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
        self.parts = {c["cluster"]: -(-c["n"] // PART) for c in clusters}
        radii = {c["cluster"]: c["radius"] for c in clusters}
        types = {n: rows.schema[n].dataType.simpleString() for n in ("id", "label")}
        schema = f"cluster int, bound double, row bigint, id {types['id']}, label {types['label']}, vector binary"
        entries = rows.mapInArrow(_listed(centres, radii, dimension, scale), schema)
        keys = ["cluster", F.desc("bound"), "id", "row"]
        ranged = entries.repartitionByRange(*keys).sortWithinPartitions(*keys)
        # The number holds the range's place and the place in the range.
        numbered = ranged.withColumn("segment", F.shiftright(F.monotonically_increasing_id(), SEGMENT.bit_length() - 1))
        self.lists = _stored(self.spark, numbered, "lists")
        self.segments = _stored(
            self.spark, self.lists.groupBy("cluster", "segment").agg(F.max("bound").alias("top")), "segments"
        )
        shares = [1 - s for s in STEPS if s < 1]
        levels = self.segments.groupBy("cluster").agg(F.percentile_approx("top", shares, 1000).alias("levels"))
        self.levels = {c["cluster"]: [*c["levels"], None] for c in levels.collect()} if shares else {}

    def _by_cluster(self, values: dict[int, object], kind: str) -> Column:
        """A value for each row's cluster, of which there are few."""
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))]
        return F.create_map(*pairs)[F.col("cluster")]

    def _of_round(self, number: int, column: str) -> Column:
        low = self._by_cluster({k: v[number] for k, v in self.levels.items()}, "double")
        inside = F.coalesce(F.col(column) >= low, F.lit(True))
        if number:
            inside &= F.col(column) < self._by_cluster({k: v[number - 1] for k, v in self.levels.items()}, "double")
        return inside

    def walk(self, members: DataFrame, kept: int, same_label: bool, purpose: str) -> DataFrame:
        """row, window, score, other_id, other_row and rank of the best of each member and window.

        Members have lows, highs and needs, arrays with an entry per window.
        """
        id_type = members.schema["id"].dataType.simpleString()
        schema = f"row bigint, window int, score bigint, other_id {id_type}, other_row bigint"
        empty = self.spark.createDataFrame([], f"{schema}, rank int")
        arrow = empty.drop("rank").limit(0).toArrow().schema
        best = empty
        for number in range(len(STEPS)):
            last = best.filter(F.col("rank") == kept).groupBy("row").agg(
                F.map_from_entries(F.collect_list(F.struct("window", F.col("score").cast("double")))).alias("reached")
            )
            asking = members.join(last, "row", "left").withColumn(
                "needs",
                F.transform("needs", lambda need, w: F.greatest(need, F.coalesce(F.element_at("reached", w.cast("int")), need))),
            )
            asking = asking.withColumn("least", F.array_min("needs"))
            tops = self.segments.filter(self._of_round(number, "top"))
            pairs = asking.drop("reached", "angle").join(tops, "cluster").filter(F.col("norm") * F.col("top") >= F.col("least"))
            pairs = pairs.drop("top", "least")
            keys = ["cluster", "segment", "part"]
            parts = self._by_cluster(self.parts, "int")
            chosen = self.lists.join(tops.select("cluster", "segment"), ["cluster", "segment"], "left_semi")
            listed = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
            listed = listed.join(pairs.select(*keys).distinct(), keys, "left_semi")
            found = (
                listed.groupBy(*keys)
                .cogroup(pairs.groupBy(*keys))
                .applyInArrow(_walk(self.dimension, kept, same_label, arrow), schema)
            )
            best = _stored(self.spark, _best(best.drop("rank").unionByName(found), kept), purpose)
        return best


def mine_negatives(
    rows: DataFrame,
    is_anchor: Column,
    how: Mining | None = None,
    seed: int = 41,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    is_anchor tells from the columns `id` and `label` which rows are anchors.
    """
    m = how or Mining()
    spark = rows.sparkSession
    usable = _usable(rows, id_col, label_col, vector_col, m.scale)
    lengths = usable.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    dimension = most["length"] if most else 1
    usable = usable.filter(F.col("length") == dimension).drop("length")
    usable = _stored(spark, usable.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")
    asking = usable.filter(is_anchor)
    id_type, label_type = (usable.schema[c].dataType.simpleString() for c in ("id", "label"))
    sample = asking.orderBy(F.xxhash64("id"), "row").limit(SAMPLE).select("values").collect()
    if sample:
        vectors = quantised(np.array([r["values"] for r in sample], np.float64), m.scale)
        n_anchors = asking.count()
        centres = fit_centres(vectors, min(MOST_CLUSTERS, -(-n_anchors // MEMBERS)), seed)
    else:
        centres = np.eye(1, dimension)
    schema = f"row bigint, id {id_type}, label {label_type}, vector binary, norm double, cluster int, angle double"
    placed = _stored(spark, asking.mapInArrow(_placed(centres, dimension, m.scale), schema), "anchors")
    shape = [
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    ]
    lists = _Lists(usable, placed, centres, dimension, m.scale) if sample else None
    if lists is None:
        types = f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score bigint, negative_score bigint"
        return spark.createDataFrame([], types)
    parts = lists._by_cluster(lists.parts, "int")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
    everything = placed.withColumns(
        {
            "lows": F.array(F.lit(-LIMIT).cast("bigint")),
            "highs": F.array(F.lit(LIMIT).cast("bigint")),
            "needs": F.array(F.lit(float("-inf"))),
        }
    )
    positives = lists.walk(everything, m.n_positives, True, "positives")
    positives = positives.select("row", F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id"), "rank")
    # ceil(low * p / 100) and floor(high * p / 100) without leaving whole numbers.
    point = F.col("positive_score").cast("decimal(38,0)")
    low = F.ceil(point * m.low / 100).cast("bigint")
    high = F.floor(point * m.high / 100).cast("bigint")
    windows = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    hunting = placed.join(windows, "row").select(
        *placed.columns,
        F.col("w.low").alias("lows"),
        F.col("w.high").alias("highs"),
        F.transform("w", lambda x: F.when(x["low"] > x["high"], F.lit(float("inf"))).otherwise(x["low"].cast("double"))).alias("needs"),
    )
    negatives = lists.walk(_stored(spark, hunting, "windows"), m.n_negatives, False, "negatives")
    negatives = negatives.select("row", (F.col("window") + 1).alias("of"), "rank", F.col("score").alias("negative_score"), F.col("other_id").alias("negative_id"))
    named = positives.withColumnRenamed("rank", "of").join(placed.select("row", F.col("id").alias("anchor_id")), "row")
    return negatives.join(named, ["row", "of"]).select(*shape)
