"""Latest and neighbouring rows of hot keys, against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators.adjacent import as_of_join, with_adjacent

LEFT = "k string, at bigint, id int, _at int"
RIGHT = "k string, since bigint, state string, size int"


def coarse(at):
    return F.floor(at / 10)


def expected(left, right):
    found = []
    for k, at, i, extra in left:
        fits = [(s, state is not None, state or "", size) for rk, s, state, size in right if None not in (k, at, s) and rk == k and s <= at]
        best = max(fits, default=None)
        found.append((k, at, i, extra, best[2] if best else None, best[3] if best else None))
    return sorted(found, key=repr)


def test_as_of_equals_a_plain_search(spark):
    rng = random.Random(1)
    keys = ["hot"] * 20 + ["a", "b", "c"]
    left = [(rng.choice(keys), rng.randint(0, 300), i, 1) for i in range(400)] + [(None, 5, 900, 1), ("a", None, 901, 1), ("none", 5, 902, 1)]
    right = [(rng.choice(keys), rng.randint(-50, 350), f"s{i}", i) for i in range(60)] + [(None, 5, "x", 1), ("a", None, "y", 2)]
    right += [("hot", 100, "s0", 7), ("hot", 100, "s0", 7), ("c", 290, "tie", 1), ("c", 290, "tie", 2)]
    joined = as_of_join(
        spark.createDataFrame(left, LEFT).repartition(3),
        spark.createDataFrame(right, RIGHT).repartition(3),
        ["k"],
        "at",
        {"state": "state", "n": "size"},
        coarse,
        since="since",
    )
    assert joined.columns == ["k", "at", "id", "_at", "state", "n"]
    assert sorted(map(tuple, joined.collect()), key=repr) == expected(left, right)


def test_as_of_of_empty_sides(spark):
    left = spark.createDataFrame([("a", 1, 1, 1)], LEFT)
    right = spark.createDataFrame([], RIGHT)
    values = {"state": "state"}
    assert [tuple(r) for r in as_of_join(left, right, ["k"], "at", values, coarse, since="since").collect()] == [("a", 1, 1, 1, None)]
    assert as_of_join(left.limit(0), right, ["k"], "at", values, coarse, since="since").count() == 0
    with pytest.raises(ValueError):
        as_of_join(left, right, ["k"], "at", values, coarse)


def test_previous_rows_of_a_hot_key(spark):
    stored = spark.createDataFrame([(f"k{i % 3}", i, "s", i) for i in range(300)], RIGHT)
    previous = with_adjacent(stored, ["k"], "since", {"before": "size"}, "lag", coarse(F.col("since")))
    assert {r.since: r.before for r in previous.collect()} == {i: i - 3 if i >= 3 else None for i in range(300)}
