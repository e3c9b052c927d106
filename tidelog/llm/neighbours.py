"""Approximate nearest neighbours by multiprobe hashing with p-stable projections.

On unit vectors the nearest by cosine are the nearest by distance. A table hashes a vector to the
cells of a few random projections, floor((a x + b) / w). A query looks into its own cell and then
into cells next to it, in the order of their estimated success: the fewer and nearer the walls
that lie between, the sooner. All vectors of a visited cell are compared exactly in the task that
holds the cell, the best of each cell are merged, and so no pair of vectors is ever a row.

Equal vectors are indexed once, with as many of their ids as an answer can need. Cells with many
vectors or queries are dealt out in parts. Queries that find too few vectors are compared with
all vectors, in parts as well.

On vectors without any structure a search has to look at much of the table to find nine of ten
neighbours: the defaults do so. Clustered vectors need far fewer probes.

Cases: vectors that are NULL, empty, zero, hold NULL or non-finite components, or have another
length than most, neither ask nor answer; ids that are NULL take no part; copies and multiples of a
vector, and all others of one cosine (to twelve digits), are ranked by id; fewer candidates than asked for give all of them; an empty table gives no rows.
"""

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shingles import scatter
from tidelog.session import work_folder

# Vectors, and queries, that are compared at once.
PART_ROWS = 2048
# Cosines that agree in so many digits are equal: those of multiples of a vector differ in the last bits.
EQUAL_DIGITS = 12
_U = np.uint64


class Tables:
    """Projections of all tables, the same for a seed wherever they are made."""

    def __init__(self, dimension: int, n_tables: int, n_projections: int, width: float, seed: int):
        random = np.random.default_rng(seed)
        a = random.normal(size=(dimension, n_tables * n_projections))
        self.directions = a / np.linalg.norm(a, axis=0)
        self.offsets = random.uniform(0, width, n_tables * n_projections)
        self.shape = (n_tables, n_projections)
        self.width = width

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Place of each vector along each projection, in cell widths, by table."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return ((unit @ self.directions + self.offsets) / self.width).reshape(len(vectors), *self.shape)

    @staticmethod
    def keys(table: int, cells: np.ndarray) -> np.ndarray:
        """One number for the cells of a table."""
        key = np.full(len(cells), table + 1, _U)
        with np.errstate(over="ignore"):
            for k in range(cells.shape[1]):
                key = scatter(key * _U(0x9E3779B97F4A7C15) + cells[:, k].astype(np.int64).view(_U))
        return key.view(np.int64)


def probe_order(inside: np.ndarray, n_probes: int) -> list[tuple[tuple[int, int], ...]]:
    """Steps from the own cell to the cells to visit: pairs (projection, -1 or 1), own cell first.

    `inside` is the place within the own cell, from 0 to 1. A step's cost is the squared distance
    to the wall it crosses, and the cells come by the sum of their costs.
    """
    walls = sorted(
        [(x * x, k, -1) for k, x in enumerate(inside.tolist())]
        + [((1 - x) ** 2, k, 1) for k, x in enumerate(inside.tolist())]
    )
    found: list[tuple[tuple[int, int], ...]] = [()]
    # Sets of walls by the places in their sorted list; each set grows out of one other.
    queue = [(walls[0][0], (0,))]
    while queue and len(found) < n_probes:
        cost, chosen = heapq.heappop(queue)
        last = chosen[-1]
        if len({walls[w][1] for w in chosen}) == len(chosen):
            found.append(tuple((walls[w][1], walls[w][2]) for w in chosen))
        if last + 1 < len(walls):
            onward = walls[last + 1][0]
            heapq.heappush(queue, (cost - walls[last][0] + onward, (*chosen[:-1], last + 1)))
            heapq.heappush(queue, (cost + onward, (*chosen, last + 1)))
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _indexed(tables: Tables):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.floor(tables.places(_matrix(batch.column("vector"))))
            for t in range(tables.shape[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tables.keys(t, cells[:, t])), batch.column("ids"), batch.column("vector")],
                    ["cell", "ids", "vector"],
                )

    return run


def _probing(tables: Tables, n_probes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                places = tables.places(_matrix(some.column("vector")))
                cells = np.floor(places).astype(np.int64)
                for t in range(tables.shape[0]):
                    rows, visited = [], []
                    for r in range(some.num_rows):
                        for steps in probe_order(places[r, t] - cells[r, t], n_probes):
                            cell = cells[r, t].copy()
                            for k, step in steps:
                                cell[k] += step
                            rows.append(r)
                            visited.append(cell)
                    chosen = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(tables.keys(t, np.array(visited))),
                            some.column("query_id").take(chosen),
                            some.column("vector").take(chosen),
                        ],
                        ["cell", "query_id", "vector"],
                    )

    return run


def _best_of_cell(k: int):
    """The k nearest distinct vectors of a cell for each query that visits it."""

    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "ids": [], "score": []})
        x = np.frombuffer(b"".join(vectors["vector"]), "<f8").reshape(len(vectors), -1)
        q = np.frombuffer(b"".join(queries["vector"]), "<f8").reshape(len(queries), -1)
        scores = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
        taken = min(k, scores.shape[1])
        ids = vectors["ids"].to_numpy()
        # Equal scores come by the smallest id, all in one number.
        later = np.empty(len(x), np.int64)
        later[np.argsort(np.array([own[0] for own in ids]), kind="stable")] = np.arange(len(x))
        key = np.rint(scores * 10.0**EQUAL_DIGITS).astype(np.int64) * len(x) - later
        best = np.argpartition(-key, taken - 1, axis=1)[:, :taken]
        rows = np.repeat(np.arange(len(q)), taken)
        return pd.DataFrame(
            {
                "query_id": queries["query_id"].to_numpy()[rows],
                "ids": ids[best.ravel()],
                "score": np.clip(scores[rows, best.ravel()], -1, 1),
            }
        )

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector, as the bytes of doubles, of the rows that take part."""
    values = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), values.alias("values")).filter("id is not null and size(values) > 0")
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("values", lambda x: x != 0))
    return rows.select("id", "values", F.size("values").alias("length"))


def _as_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("values")
        ends = values.offsets.to_numpy()
        flat = values.values.to_numpy(zero_copy_only=False).astype("<f8")
        blobs = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        rest = [batch.column(n) for n in batch.schema.names if n != "values"]
        names = [n for n in batch.schema.names if n != "values"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(blobs, pa.binary())], [*names, "vector"])


def _compared(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Best vectors of each query in each cell; cells are dealt out in parts by their sizes."""
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asked = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    parts = sizes.join(asked, "cell").select(
        "cell",
        F.ceil(F.col("n") / PART_ROWS).cast("int").alias("n_parts"),
        F.ceil(F.col("m") / PART_ROWS).cast("int").alias("m_parts"),
    )

    def dealt(rows: DataFrame, own: str, other: str, own_part: str, other_part: str, by: Column) -> DataFrame:
        placed = rows.join(parts, "cell").withColumn(own_part, F.pmod(F.hash(by), F.col(own)))
        placed = placed.withColumn(other_part, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return placed.drop("n_parts", "m_parts")

    left = dealt(index, "n_parts", "m_parts", "part", "asking", F.col("vector"))
    right = dealt(probes, "m_parts", "n_parts", "asking", "part", F.col("query_id"))
    keys = ["cell", "part", "asking"]
    id_type = probes.schema["query_id"].dataType.simpleString()
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _best_of_cell(k), f"query_id {id_type}, ids array<{id_type}>, score double"
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best ids of each query: highest score first, ties by id."""
    merged = found.groupBy("query_id", "ids").agg(F.max("score").alias("score"))
    rows = merged.select("query_id", "score", F.explode("ids").alias("id")).filter("id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", EQUAL_DIGITS)), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    n_tables: int = 6,
    n_projections: int = 8,
    width: float = 0.3,
    n_probes: int = 80,
    seed: int = 29,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, id and score (cosine) of the k nearest found of each query row.

    is_query tells from the column `id` which rows ask; every row but the query's own answers.
    """
    rows = _usable(vectors, id_col, vector_col)
    lengths = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    dimension = most["length"] if most else 1
    rows = rows.filter(F.col("length") == dimension)
    id_type = rows.schema["id"].dataType.simpleString()
    copies = Window.partitionBy("values").orderBy("id")
    distinct = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    distinct = distinct.groupBy("values").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = distinct.mapInArrow(_as_bytes, f"ids array<{id_type}>, vector binary")
    queries = rows.filter(is_query).select(F.col("id").alias("query_id"), "values")
    queries = queries.mapInArrow(_as_bytes, f"query_id {id_type}, vector binary")
    tables = Tables(dimension, n_tables, n_projections, width, seed)
    index = distinct.mapInArrow(_indexed(tables), f"cell bigint, ids array<{id_type}>, vector binary")
    probes = queries.mapInArrow(_probing(tables, n_probes), f"cell bigint, query_id {id_type}, vector binary")
    # One more than asked for, since the query's own vector may be among them.
    folder = work_folder(vectors.sparkSession, "neighbours")
    _ranked(_compared(index, probes, k + 1), k).write.parquet(folder)
    found = vectors.sparkSession.read.parquet(folder)
    found_enough = found.filter(F.col("rank") == k).select("query_id")
    lacking = queries.join(found_enough, "query_id", "left_anti")
    shape = ["query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"]
    if lacking.isEmpty():
        return found.select(*shape)
    parts = F.lit(max(1, rows.count() // PART_ROWS))
    everywhere = distinct.withColumn("cell", F.pmod(F.xxhash64("vector"), parts))
    asked = lacking.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint"))))
    rest = _ranked(_compared(everywhere.select("cell", "ids", "vector"), asked.select("cell", "query_id", "vector"), k + 1), k)
    whole = found.join(found_enough, "query_id", "left_semi").unionByName(rest)
    return whole.select(*shape)
