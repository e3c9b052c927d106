"""Hard negatives against a plain search of everything."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, row string, cluster string, score int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "r", "c", 1) for r in rows], SCHEMA).repartition(3)


def brute(rows, anchors, m=negatives.Mining()):
    usable = []
    for i, label, x in rows:
        if i is None or label is None or not x or any(v is None or not np.isfinite(v) for v in x):
            continue
        usable.append((i, label, [int(np.floor(m.scale * float(np.float32(v)))) for v in x]))
    counts = Counter(len(v) for _, _, v in usable)
    length = min(counts, key=lambda n: (-counts[n], n)) if counts else 0
    usable = [u for u in usable if len(u[2]) == length]
    found = []
    for a, label, x in usable:
        if not anchors(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y in usable if i != a)
        positives = [(-s, i) for s, i, other in scored if other == label][: m.n_positives]
        for p, pid in positives:
            fits = [(-s, i) for s, i, other in scored if other != label and m.low * p <= 100 * -s <= m.high * p]
            found += [(a, pid, r, i, p, s) for r, (s, i) in enumerate(fits[: m.n_negatives], 1)]
    return sorted(found)


def mined(spark, rows, every=10, **options):
    df = negatives.mine_negatives(table(spark, rows), F.col("id") % every == 0, **options)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def clustered(n, dimension, n_groups, seed, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(n_groups, dimension))
    return [
        (i, int(rng.integers(0, 4)), (middles[i % n_groups] + spread * rng.normal(size=dimension)).astype(np.float32).tolist())
        for i in range(n)
    ]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SEGMENT", 32), ("BLOCK", 8), ("PART", 5), ("MEMBERS", 8)):
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("spread", [0.2, 5.0])
def test_equals_brute_force(spark, small, spread):
    rows = clustered(600, 12, 6, 3, spread)
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_ties_copies_and_unusable_rows(spark, small):
    rng = np.random.default_rng(5)
    base = rng.normal(size=6).round(1).tolist()
    rows = [(i, i % 3, base) for i in range(60)]
    rows += [(100 + i, i % 3, [0.7 * v for v in base]) for i in range(40)]
    rows += [(200 + i, 1, [0.0] * 6) for i in range(5)]
    bad = [None, [], [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    rows += [(300 + 10 * i, 1, v) for i, v in enumerate(bad)] + [(None, 1, base), (400, None, base)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert {a for a, *_ in got} == {*range(0, 60, 10), *range(100, 140, 10), 200}


def test_repeated_rows_count_as_often_as_they_come(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.7, 0.1]), (2, 2, [0.7, 0.1])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_stay_exact(spark, small):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, (v * 3e6).astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(80, 4)))]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and max(r[4] for r in got) > 2**53
    huge = [(0, 1, [3e38, 1.0]), (1, 1, [3e38, 2.0]), (2, 2, [1e38, 0.0])]
    assert all(abs(r[4]) <= 2**63 - 1 for r in mined(spark, huge))


def test_few_rows_and_empty_table(spark):
    rows = [(0, 1, [1.0, 0.0]), (3, 1, [0.5, 0.1]), (4, 2, [0.3, 0.0])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_clustered_lists_end_early(spark, small):
    """A certified end leaves most of a list unread where vectors have structure."""
    x = np.array([v for _, _, v in clustered(4000, 16, 8, 9, 0.05)])
    v = negatives.quantised(x, 256)
    centres = negatives.fit_centres(v[::50], 8, 1)
    angles = negatives._angles(v, centres)
    nearest = angles.argmin(axis=1)
    visited = []
    for c in set(nearest[::50].tolist()):
        members = [i for i in range(0, 4000, 50) if nearest[i] == c]
        radius = max(angles[i, c] for i in members)
        bound = negatives.norms(v) * np.cos(np.maximum(0, angles[:, c] - radius))
        for u in members:
            best = np.sort(v @ v[u])[-6]
            visited.append((bound * negatives.norms(v[u : u + 1])[0] >= best).mean())
    assert np.mean(visited) < 0.3


def test_bounds_hold(spark):
    """No inner product exceeds the bound its list is ordered by."""
    rng = np.random.default_rng(2)
    v = negatives.quantised(rng.normal(size=(500, 5)) * rng.lognormal(size=(500, 1)), 256)
    u = v[:50]
    centres = negatives.fit_centres(u, 4, 3)
    own = negatives._angles(u, centres)
    every = negatives._angles(v, centres)
    for c in range(len(centres)):
        members = u[own.argmin(axis=1) == c]
        radius = own[own.argmin(axis=1) == c, c].max()
        bound = negatives.norms(v) * (np.cos(np.maximum(0, every[:, c] - radius - 1e-6)) + 1e-9)
        assert (members @ v.T <= negatives.norms(members)[:, None] * bound[None, :]).all()
