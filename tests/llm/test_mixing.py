"""Mixing against brute force: targets, apportionment and what is taken."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing


def brute_targets(sizes, weights, most=3):
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in full]
        left = Fraction(total - sum(most * sizes[s] for s in full))
        shares = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        above = {s for s in rest if shares[s] > most * sizes[s]}
        if not above:
            return {s: float(shares.get(s, most * sizes[s])) for s in sizes}
        full |= above


@pytest.mark.parametrize(
    "sizes", [[10, 10, 10], [1, 1, 100], [1, 2, 3, 4, 500], [0, 5, 5], [7], [100, 1, 1, 1, 1, 1], [3, 1000, 2, 999, 1]]
)
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size bigint")
    weighted = mixing.weigh_in_turn(rows, (1, 2, 3))
    weights = {r.source: r.weight for r in weighted.collect()}
    assert [weights[n] for n in names] == [(1, 2, 3)[i % 3] for i in range(len(names))]
    got = {r.source: r.target for r in mixing.set_targets(weighted).collect()}
    expected = brute_targets(dict(zip(names, sizes)), weights)
    assert got == pytest.approx(expected)
    assert sum(got.values()) == pytest.approx(sum(sizes))


def brute_seats(claims, seats):
    """Seat by seat to the highest quotient, ties by name."""
    won = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = min((n for n in claims if claims[n] > 0), key=lambda n: (-(claims[n] / (2 * won[n] + 1)), n), default=None)
        if best is not None:
            won[best] += 1
    return won


@pytest.mark.parametrize("seats", [0, 1, 2, 7, 100, 1001])
def test_apportionment(spark, seats):
    groups = {"a": {"p": 53, "q": 24, "r": 23, "z": 0}, "b": {"x": 1, "y": 1, "w": 1000}, "c": {"u": 5}}
    rows = [(g, n, c, seats) for g, claims in groups.items() for n, c in claims.items()]
    df = spark.createDataFrame(rows, "g string, n string, c bigint, seats bigint")
    got = {(r.g, r.n): r.quota for r in mixing.apportion(df, ["g"], ["n"], "c", "seats").collect()}
    for g, claims in groups.items():
        assert {n: got[g, n] for n in claims} == brute_seats(claims, seats)


ROWS = [(i, "w " * (1 + i % 17), "en", f"s{i % 3}") for i in range(300)]
ROWS += [(1000 + i, "a b c", "en", "tiny") for i in range(2)]
ROWS += [(2000 + i, "x y", "en", None) for i in range(40)] + [(3000, None, "en", "s1"), (3001, "", None, "nothing")]
ROWS += [(5, "w " * 6, "en", "s2")] * 3 + [(None, "n n n", "en", "s0")] * 2


def test_words_taken(documents):
    docs = documents(ROWS)
    got = mixing.mix_sources(docs, n_shards=4).collect()
    assert len(got) == len(ROWS)
    names = {r[0]: r[3] for r in ROWS}
    names[5] = "s2"
    taken, target = {}, {}
    for r in got:
        source = names[r.doc_id]
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
        cut = sum(s.to_word - s.from_word for s in r.cuts)
        assert r.taken == r.passes * r["size"] + cut
    sizes = {}
    for _, t, _, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(s for s in sizes if s is not None) + [None]
    expected = brute_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    assert target == pytest.approx(expected)
    assert all(abs(taken[s] - expected[s]) <= 2 for s in expected)
    again = mixing.mix_sources(docs.repartition(5), n_shards=4)
    key = lambda r: (r.doc_id or -1, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))


def test_small_and_full_sources_beside_a_huge_one(documents):
    """Blocks far larger than the shards of a source leave none of its target out."""
    rows = [(i, "w " * 500, "en", "a") for i in range(400)]
    rows += [(1000 + i, "w " * (1 + i % 5), "en", "many") for i in range(640)]
    rows += [(2000 + i, "w " * 30, "en", "medium") for i in range(200)]
    rows += [(3000, "x y z", "en", "one"), (3001, None, "en", "none"), (3002, "u v", "en", None)]
    names = {r[0]: r[3] for r in rows}
    got = mixing.mix_sources(documents(rows), n_blocks=100).collect()
    taken, target, sizes = {}, {}, {}
    for r in got:
        source = names[r.doc_id]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
        sizes[source] = sizes.get(source, 0) + r["size"]
        target[source] = r.target
    for source in ("many", "medium", "one", "none", None):
        assert target[source] == 3 * sizes[source] and taken[source] == target[source]
    assert abs(taken["a"] - target["a"]) <= 1
    # A huge source stays in whole blocks, and what small ones take by the word is not given twice.
    got = mixing.mix_sources(documents(rows), n_blocks=2000).collect()
    block = -(-sum(r["size"] for r in got) // 2000)
    taken = {s: sum(r.taken for r in got if names[r.doc_id] == s) for s in sizes}
    assert taken["a"] % block == 0 and abs(taken["a"] - target["a"]) <= block
    assert all(taken[s] == target[s] for s in sizes if s != "a")


def test_targets_below_half_a_block(documents):
    """Sources that are not full either, with targets far below a block."""
    rows = [(i, "w " * 50, "en", f"s{i:03d}") for i in range(600)] + [(1000 + i, "w " * 600, "en", "z") for i in range(100)]
    names = {r[0]: r[3] for r in rows}
    got = mixing.mix_sources(documents(rows), weights=(1, 2, 1000), n_blocks=300).collect()
    taken, target = {}, {}
    for r in got:
        source = names[r.doc_id]
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)


def test_mixed_documents(documents):
    docs = documents(ROWS)
    mixed = mixing.mixed_documents(docs, chars_col="n_chars", n_shards=4)
    assert mixed.schema == docs.schema
    words = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    expected = {}
    for r in mixing.mix_sources(docs, n_shards=4).collect():
        if r.taken:
            expected[r.doc_id] = expected.get(r.doc_id, 0) + r.taken
    assert words == expected


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string, n_chars bigint")
    assert mixing.mix_sources(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    blank = docs.union(spark.createDataFrame([(1, None, "s", 0), (2, " ", None, 1)], docs.schema))
    assert [r.taken for r in mixing.mix_sources(blank).collect()] == [0, 0]
    assert mixing.mix_sources(blank).filter(F.col("target") != 0).count() == 0
