"""Nearest neighbours against an exact search."""

import heapq
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import neighbours


def exact(ids, x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for q in queries:
        scores = np.array([sum(a * b for a, b in zip(unit[ids.index(q)], u)) for u in unit])
        order = sorted((-round(s, 12), i) for s, i in zip(scores, ids) if i != q)
        found[q] = [(i, -s) for s, i in order[:k]]
    return found


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cell string, ids int").repartition(3)


def answers(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return found


def test_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    rows = [(i, v.tolist(), "c", 1) for i, v in enumerate(x)]
    got = answers(neighbours.nearest(table(spark, rows), F.col("id") % 50 == 0))
    queries = list(range(0, 3000, 50))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in queries:
        scores = unit[q] @ unit.T
        scores[q] = -9
        best = np.argsort(-scores)[:5]
        hits += len({i for _, i, _ in got[q]} & set(best.tolist()))
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(scores[i], abs=1e-12) for _, i, s in got[q])
        assert [s for _, _, s in got[q]] == sorted((s for _, _, s in got[q]), reverse=True)
    assert hits >= 0.9 * 5 * len(queries)


def test_copies_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=8).round(2).tolist()
    rows = [(i, base, "c", 1) for i in range(0, 90)]
    rows += [(200 + i, rng.normal(size=8).round(2).tolist(), "c", 1) for i in range(20)]
    bad = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0]]
    rows += [(300 + 50 * i, v, "c", 1) for i, v in enumerate(bad)] + [(None, base, "c", 1)]
    got = answers(neighbours.nearest(table(spark, rows), F.col("id") % 50 == 0))
    assert set(got) == {0, 50, 200}
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for _, i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(s == pytest.approx(1) for _, _, s in got[0])
    usable = [(i, v) for i, v, _, _ in rows if i is not None and i < 300]
    ids, x = [i for i, _ in usable], np.array([np.array(v, np.float32) for _, v in usable], float)
    assert [i for _, i, _ in got[200]] == [i for i, _ in exact(ids, x, [200], 5)[200]]


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0], "c", 1), (3, [0.0, 1.0], "c", 1), (7, [-1.0, 0.5], "c", 1)]
    got = answers(neighbours.nearest(table(spark, rows), F.col("id") == 0, n_probes=1, n_tables=1))
    assert [(r, i) for r, i, _ in got[0]] == [(1, 3), (2, 7)]
    assert neighbours.nearest(table(spark, rows[:1]), F.col("id") == 0).count() == 0
    assert neighbours.nearest(table(spark, []), F.col("id") == 0).count() == 0


def test_probes_come_by_their_cost():
    inside = np.array([0.1, 0.55, 0.8])
    got = neighbours.probe_order(inside, 100)
    cost = {(k, -1): inside[k] ** 2 for k in range(3)} | {(k, 1): (1 - inside[k]) ** 2 for k in range(3)}
    every = [tuple((k, d) for k, d in enumerate(steps) if d) for steps in product((-1, 0, 1), repeat=3)]
    assert {frozenset(s) for s in got} == {frozenset(s) for s in every} and len(got) == 27
    costs = [sum(cost[s] for s in steps) for steps in got]
    assert costs == sorted(costs) and costs == pytest.approx(heapq.nsmallest(27, (sum(cost[s] for s in e) for e in every)))


@pytest.mark.parametrize("part_rows", [16, 2048])
def test_multiples_of_a_vector_are_ranked_by_id(spark, monkeypatch, part_rows):
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    rng = np.random.default_rng(11)
    base = rng.normal(size=16)
    rows = [(0, base.tolist(), "c", 1)] + [(i, (base * rng.uniform(0.1, 9)).tolist(), "c", 1) for i in range(1, 90)]
    rows += [(100 + i, rng.normal(size=16).tolist(), "c", 1) for i in range(200)]
    rng.shuffle(rows)
    table = spark.createDataFrame(
        [(int(i), [float(v) for v in x], c, int(n)) for i, x, c, n in rows], "vec_id bigint, embedding array<double>, cell string, ids int"
    )
    got = answers(neighbours.nearest(table.repartition(4), F.col("id") % 50 == 0))
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for _, i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(s == pytest.approx(1, abs=1e-12) and s <= 1 for _, _, s in got[0])
