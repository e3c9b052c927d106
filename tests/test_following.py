"""Files that grow while they are followed, and entries that go on from batch to batch."""

import os

import pytest
from pyspark.sql import functions as F

from tidelog.sources import follow
from tidelog.streaming import entries


class Folder:
    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        os.makedirs(f"{root}/logs")

    def add(self, name, text):
        with open(f"{self.root}/logs/{name}", "ab") as file:
            file.write(text if isinstance(text, bytes) else text.encode())

    def rename(self, old, new):
        os.rename(f"{self.root}/logs/{old}", f"{self.root}/logs/{new}")

    def cut_off(self, name):
        os.truncate(f"{self.root}/logs/{name}", 0)

    def follow(self, pattern="*.log*", **options):
        return follow.follow_files(self.spark, f"{self.root}/logs/{pattern}", **options)

    def run(self, pattern="*.log*", **options):
        """One run of a query on the same checkpoint; returns all lines stored so far."""
        writer = self.follow(pattern, **options).writeStream.format("parquet")
        stream = writer.option("checkpointLocation", f"{self.root}/checkpoint").start(f"{self.root}/table")
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        return self.lines()

    def lines(self):
        rows = self.spark.read.schema(follow.SCHEMA).parquet(f"{self.root}/table")
        return sorted(r.value for r in rows.collect())


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path)


def test_appended_lines_come_once(folder):
    folder.add("a.log", "a1\na2\nhalf")
    folder.add("b.log", "no line end yet")
    assert folder.run() == ["a1", "a2"]
    folder.add("a.log", " a3\r\n\na5\n")
    folder.add("b.log", "\nb2\n")
    folder.add("c.log", b"\xff\xfe\n")
    assert folder.run() == ["", "a1", "a2", "a5", "b2", "half a3", "no line end yet", "��"]
    assert len(folder.run()) == 8


def test_lines_of_a_running_stream(spark, folder):
    folder.add("a.log", "1\n")
    writer = folder.follow().writeStream.format("parquet").trigger(processingTime="0 seconds")
    stream = writer.option("checkpointLocation", f"{folder.root}/checkpoint").start(f"{folder.root}/table")
    try:
        for n in range(2, 5):
            stream.processAllAvailable()
            folder.add("a.log", f"{n}\n")
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert folder.lines() == ["1", "2", "3", "4"]


def test_renamed_files_go_on_and_new_ones_begin(folder):
    folder.add("a.log", "old 1\nold 2\n")
    assert folder.run() == ["old 1", "old 2"]
    folder.add("a.log", "old 3\n")
    folder.rename("a.log", "a.log.1")
    folder.add("a.log", "new 1\n")
    assert folder.run() == ["new 1", "old 1", "old 2", "old 3"]
    folder.rename("a.log.1", "a.log.2")
    folder.rename("a.log", "a.log.1")
    folder.add("a.log", "newest\n")
    assert folder.run() == ["new 1", "newest", "old 1", "old 2", "old 3"]


def test_files_cut_off_begin_anew(folder):
    folder.add("a.log", "head\nx 1\nx 2\n")
    folder.run()
    folder.cut_off("a.log")
    folder.add("a.log", "head\ny\n")
    assert folder.run() == ["head", "head", "x 1", "x 2", "y"]
    folder.cut_off("a.log")
    assert len(folder.run()) == 5
    folder.add("a.log", "other head\n")
    assert folder.run() == ["head", "head", "other head", "x 1", "x 2", "y"]


def test_start_at_the_end_takes_later_lines_only(folder):
    folder.add("a.log", "old\n")
    assert folder.run(start_at="end") == []
    folder.add("a.log", "new\n")
    folder.add("b.log", "first\n")
    assert folder.run(start_at="end") == ["first", "new"]
    with pytest.raises(Exception, match="startAt"):
        folder.follow(start_at="middle")


def test_pieces_are_cut_at_line_ends(tmp_path):
    os.makedirs(f"{tmp_path}/x/y")
    lines = [b"x" * (i % 40) for i in range(500)]
    with open(f"{tmp_path}/x/y/a.log", "wb") as file:
        file.write(b"\n".join(lines) + b"\nrest")
    reader = follow.GrowingFilesReader({"path": f"{tmp_path}/*/y/?.log", "pieceBytes": "100"})
    end = reader.latestOffset()
    pieces = reader.partitions({}, end)
    assert len(pieces) > 50 and [p.begin for p in pieces[1:]] == [p.end for p in pieces[:-1]]
    read = [row for p in pieces for batch in reader.read(p) for row in batch.to_pylist()]
    assert [r["value"].encode() for r in read] == lines
    offsets = [0]
    for line in lines[:-1]:
        offsets.append(offsets[-1] + len(line) + 1)
    assert [r["offset"] for r in read] == offsets
    assert reader.partitions(end, end) == []


def test_a_planned_batch_is_read_the_same_after_a_rename(tmp_path):
    path = f"{tmp_path}/a.log"
    with open(path, "w") as file:
        file.write("1\n2\n")
    reader = follow.GrowingFilesReader({"path": f"{tmp_path}/a.log*"})
    end = reader.latestOffset()
    (piece,) = reader.partitions({}, end)
    os.rename(path, f"{path}.1")
    with open(path, "w") as file:
        file.write("other\n")
    for pieces in ([piece], reader.partitions({}, end)):
        assert [r["value"] for p in pieces for b in reader.read(p) for r in b.to_pylist()] == ["1", "2"]
    os.remove(f"{path}.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(piece))


def test_an_entry_over_batches_and_a_restart_comes_once(spark, folder):
    def run(texts, quiet, close=False):
        lines = folder.follow(piece_bytes=4)
        stream = entries.start_entries(lines, "^[A-Z]", f"{folder.root}/table", f"{folder.root}/checkpoint", quiet, 0.2)
        try:
            for text in texts:
                folder.add("a.log", text)
                entries.drain(stream)
            entries.drain(stream, close)
        finally:
            stream.stop()
        rows = spark.read.schema(entries.ENTRY).parquet(f"{folder.root}/table").collect()
        return sorted((r.offset, r.n_lines, r.message) for r in rows)

    assert run(["before any\n", "Error one\n  at x\n", "  at y\n"], 3600) == [(0, 1, "before any")]
    first = [(0, 1, "before any"), (11, 4, "Error one\n  at x\n  at y\n  at z")]
    assert run(["  at z\nError two\n"], 3600) == first
    last = [(42, 1, "Error two"), (52, 3, "Error 3\n\n end")]
    assert run(["Error 3\n\n end\n"], 1, close=True) == first + last


def test_pieces_join_whole_entries(spark):
    rows = [("f", "p", i, text) for i, text in enumerate("a A b c B C d".split())]
    marked = spark.createDataFrame(rows, "file_id string, file_path string, offset bigint, value string").coalesce(1)
    marked = marked.orderBy("offset").withColumn("starts", F.col("value").rlike("^[A-Z]"))
    found = marked.coalesce(1).mapInArrow(entries._join_pieces, entries.FRAGMENT).collect()
    assert [(r.offset, r.n_lines, r.message, r.starts, r.closed, r.edge) for r in found] == [
        (0, 1, "a", False, True, True),
        (1, 3, "A\nb\nc", True, True, False),
        (4, 1, "B", True, True, False),
        (5, 2, "C\nd", True, False, True),
    ]


def test_many_small_pieces_share_tasks(tmp_path):
    for n in range(300):
        with open(f"{tmp_path}/{n:03}.log", "w") as file:
            file.writelines(f"{n}:{i}\n" for i in range(50))
    reader = follow.GrowingFilesReader({"path": f"{tmp_path}/*.log", "pieceBytes": "40"})
    tasks = reader.partitions({}, reader.latestOffset())
    pieces = [p for t in tasks for p in t.pieces]
    assert len(tasks) < 2 * follow.SINGLE_PIECES < len(pieces)
    read = [row["value"] for t in tasks for batch in reader.read(t) for row in batch.to_pylist()]
    assert len(read) == 15_000 and set(read) == {f"{n}:{i}" for n in range(300) for i in range(50)}
    assert all(a.file_id != b.file_id or a.end == b.begin for t in tasks for a, b in zip(t.pieces, t.pieces[1:], strict=False))


def test_whole_entries_of_many_files_keep_their_files(spark, folder):
    for n in range(40):
        folder.add(f"{n}.log", "".join(f"E {n} {i}\n at\n" for i in range(60)))
    lines = folder.follow()
    stream = entries.start_entries(lines, "^E", f"{folder.root}/table", f"{folder.root}/checkpoint", 3600, 0.2)
    try:
        entries.drain(stream)
    finally:
        stream.stop()
    rows = spark.read.schema(entries.ENTRY).parquet(f"{folder.root}/table").collect()
    # The last entry of each file stays open.
    assert sorted(r.message for r in rows) == sorted(f"E {n} {i}\n at" for n in range(40) for i in range(59))
    assert len({r.file_id for r in rows}) == 40 and all(r.message.split()[1] in r.file_path for r in rows)
