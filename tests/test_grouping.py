"""Operators that split hot groups, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.functions import timefmt
from tidelog.operators.adjacent import with_adjacent
from tidelog.operators.multiline import entry_parts, group_multiline, label_lines
from tidelog.sources.files import read_text_lines
from workload import logs

TRACE = """[07:15:02] WARN pool.orders: lease not renewed
Traceback (most recent call last):
  File "pool.py", line 88, in renew
    raise LeaseLost(self.owner)
pool.LeaseLost: worker-4

[07:15:02] INFO pool.orders: lease given up
[07:15:09] WARN pool.orders: two workers left
  worker-1 since 06:58
"""
START = r"^\[\d{2}:\d{2}:\d{2}\]"


def test_trace_is_one_entry(spark, tmp_path):
    (tmp_path / "a.log").write_text(TRACE)
    entries = group_multiline(read_text_lines(spark, str(tmp_path)), START).orderBy("entry").collect()
    lines = TRACE.splitlines()
    assert [r.message for r in entries] == ["\n".join(lines[:6]), lines[6], "\n".join(lines[7:])]
    assert [(r.entry, r.n_lines) for r in entries] == [(1, 6), (2, 1), (3, 2)]


def test_a_long_entry_is_one_row(spark):
    rows = [("f", 0, i, "x" * 1000 if i else "S") for i in range(3000)]
    df = spark.createDataFrame(rows, "file_path string, block bigint, row bigint, value string")
    (entry,) = group_multiline(df, "^S", chunk_lines=64).collect()
    assert (entry.n_lines, len(entry.message)) == (3000, 1 + 2999 * 1001)


def test_a_long_entry_stays_in_parts(spark):
    rows = [("f", i // 100, i % 100, f"{i}" if i else "S") for i in range(1000)]
    df = spark.createDataFrame(rows, "file_path string, block bigint, row bigint, value string")
    parts = entry_parts(df, "^S", chunk_lines=30)
    found = sorted(parts.collect(), key=lambda r: r.place)
    assert {(r.file_path, r.entry) for r in found} == {("f", 1)} and max(r.n_lines for r in found) == 30
    assert "\n".join(r.part for r in found).split("\n") == ["S", *map(str, range(1, 1000))]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file_path#\d+, entry", plan)


def brute_entries(files):
    entries = {}
    for file, lines in files.items():
        entry = 0
        for line in lines:
            entry += bool(re.search("^S", line))
            entries.setdefault((file, entry), []).append(line)
    return {k: "\n".join(v) for k, v in entries.items()}


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_entries_equal_brute_force(spark, chunk):
    rng = random.Random(chunk)
    sizes = {"hot": 400, "small": 17, "one": 1, "empty lines": 30}
    files = {
        name: [("S" if rng.random() < 0.2 else "c") + "x" * rng.randrange(8) for _ in range(n)]
        for name, n in sizes.items()
    }
    files["empty lines"] = [rng.choice(["", "S", ""]) for _ in range(30)]
    rows = [(f, i // 50, i % 50, line) for f, lines in files.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file_path string, block bigint, row bigint, value string")
    got = group_multiline(df, "^S", chunk_lines=chunk).collect()
    expected = brute_entries(files)
    assert {(r.file_path, r.entry): r.message for r in got} == expected
    assert sum(r.n_lines for r in got) == sum(len(x) for x in files.values())
    labelled = label_lines(df, "^S", chunk_lines=chunk).collect()
    again = {}
    for r in sorted(labelled, key=lambda r: (r.file_path, r.entry, r.line_in_entry)):
        again.setdefault((r.file_path, r.entry), []).append(r.value)
    assert {k: "\n".join(v) for k, v in again.items()} == expected
    assert len({(r.file_path, r.entry, r.line_in_entry) for r in labelled}) == len(labelled)


def test_only_sums_are_shuffled_by_file(spark):
    rows = [("f", 0, i, str(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "file_path string, block bigint, row bigint, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = group_multiline(df, "^S")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    keys = [re.sub(r"#\d+L?", "", s).split(", ") for s in shuffles]
    # Sums by chunk, sums by file, sums by chunk for the join; lines by chunk; fragments.
    assert keys.count(["_file"]) == 1 and len(keys) == 5
    lines = plan.splitlines()
    by_file = next(i for i, line in enumerate(lines) if re.search(r"hashpartitioning\(_file#\d+, \d+\)", line))
    assert "HashAggregate" in lines[by_file + 1] and "sum(" in lines[by_file + 1]


@pytest.mark.parametrize("direction", ["lag", "lead"])
def test_adjacent_rows_equal_brute_force(spark, direction):
    rng = random.Random(1)
    rows = {("hot", t, rng.randrange(100)) for t in rng.sample(range(3000), 500)}
    rows |= {(f"k{i}", t, rng.randrange(100)) for i in range(5) for t in rng.sample(range(3000), 3)}
    rows |= {("single", 5, 1)}
    df = spark.createDataFrame(sorted(rows), "k string, t bigint, v int")
    got = with_adjacent(
        df, ["k"], "t", {"other_v": "v", "other_t": "t"}, direction, timefmt.int_div(F.col("t"), 100)
    )
    expected = set()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, r in enumerate(mine):
            j = i - 1 if direction == "lag" else i + 1
            other = mine[j] if 0 <= j < len(mine) else (None, None, None)
            expected.add((*r, other[2], other[1]))
    assert {tuple(r) for r in got.collect()} == expected
    assert got.columns == ["k", "t", "v", "other_v", "other_t"]


def test_each_streamed_file_is_written_by_a_task_of_its_own(spark):
    rows = spark.range(80).select((F.col("id") % 8).alias("file"), F.col("id").alias("doc_id"))
    placed = logs._one_file_each(rows).select("file", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(placed) == 8 and len({r.task for r in placed}) == 8
