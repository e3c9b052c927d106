"""Sharding against its own law, worked out in plain Python."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import sharding


def brute_permuted(number, n_rows, seed):
    mask = sharding.LOW_31
    rounds = sharding.network(n_rows, seed)

    def scramble(x, key):
        x = (x + key) & mask
        for m in (*sharding.MULTIPLIERS, 1):
            x = ((x ^ (x >> 14)) * m) & mask
        return x

    def permute(v):
        for key, left, right in rounds:
            low = v & ((1 << right) - 1)
            v = low << left | (v >> right) ^ (scramble(low, key) & ((1 << left) - 1))
        return v

    v = permute(number)
    while v >= n_rows:
        v = permute(v)
    return v


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 1024, 1025])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 17).alias("p"), "id").orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    assert got == [brute_permuted(i, n, 17) for i in range(n)]


def rows_of(docs, n_shards=4, seed=3):
    return sharding.shard_rows(docs, n_shards, seed).collect()


def test_places_of_documents(documents):
    rows = [(i, f"text {i % 7} é" * (i % 3), "en", "s") for i in range(50)]
    rows += [(None, None, None, None)] * 2 + [(7, "text 0 é", "en", "s")] * 30 + [(1, "", "en", "s")]
    got = rows_of(documents(rows))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(4))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    # Places follow from the order of the keys and the permutation alone.
    ordered = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]))
    places = [r.slot * 4 + r.shard for r in ordered]
    expected = [brute_permuted(i, len(rows), 3) for i in range(len(rows))]
    for key in {(r.doc_id, r.text_crc32, r["size"]) for r in ordered}:
        same = [i for i, r in enumerate(ordered) if (r.doc_id, r.text_crc32, r["size"]) == key]
        assert sorted(places[i] for i in same) == sorted(expected[i] for i in same)


def test_reruns_and_partitions_do_not_matter(documents):
    docs = documents([(i, f"t{i}", "en", "s") for i in range(100)])
    first = {tuple(r) for r in rows_of(docs)}
    assert first == {tuple(r) for r in rows_of(docs.repartition(11))}
    assert first != {tuple(r) for r in rows_of(docs, seed=4)}


def test_empty_table(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id bigint, text string"), 24).count() == 0


def test_written_shards(documents, spark, tmp_path):
    rows = [(i, f"text {i}", "en", "s") for i in range(40)] + [(3, "text 3", "de", "s")] * 2 + [(None, None, None, None)]
    docs = documents(rows)
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    written = spark.read.parquet(f"{tmp_path}/out").select("row.*", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in written) == Counter((i, t, lang) for i, t, lang, _ in rows)
    assert len({(r.shard, r.slot) for r in written}) == len(rows)
