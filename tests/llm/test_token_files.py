"""Token files against the tokenizer's own library, and the file format's promises."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidelog.llm import part_encoder, token_files
from tidelog.llm.part_encoder import PartEncoder
from tidelog.session import work_folder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "é", "中", "1", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "!?", " ", "😀", "_", "don't", "\0", "²", "<|endoftext|>", " .", " '", "\r\n", "Word", "word"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def some_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)]


def decoded(blobs):
    return [np.frombuffer(b, "<u2").tolist() for b in blobs]


def test_parts_give_the_library_s_ids(library, monkeypatch):
    """Also when little is remembered, and when texts are worked on in short slices."""
    texts = some_texts(3000, 1)
    wanted = [plain(library, t) for t in texts]
    assert decoded(PartEncoder(BYTES).encode(texts)) == wanted
    monkeypatch.setattr(part_encoder, "REMEMBERED_BYTES", 20_000)
    monkeypatch.setattr(part_encoder, "SLICE_CHARS", 7)
    small = PartEncoder(BYTES)
    got = []
    for begin in range(0, len(texts), 100):
        got += decoded(small.encode(texts[begin : begin + 100]))
        assert sum(len(p) + len(i) + part_encoder.PART_COST for p, i in small.known.items()) <= 20_000
    assert got == wanted


def test_long_words_are_not_remembered(library):
    encoder = PartEncoder(BYTES)
    texts = ["中" * 20_000 + f" {i}" for i in range(3)]
    assert decoded(encoder.encode(texts)) == [plain(library, t) for t in texts]
    assert max(map(len, encoder.known)) <= part_encoder.LONGEST_PART


def read(spark, docs, **options):
    folder = work_folder(spark, "test-token-files")
    index = token_files.write_token_files(docs, BYTES, folder, **options)
    return folder, index, token_files.read_token_files(index, folder).collect()


def wanted_rows(library, rows, end_id=2):
    at, found = 0, []
    for doc_id, text in rows:
        ids = [*plain(library, text), end_id]
        found.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return found


def test_rows_equal_the_library_s(spark, documents, library, monkeypatch):
    texts = [None, "", *some_texts(200, 2), "long words and lines\n" * 5000]
    rows = [(i * 7 % 211, t, "en", "s") for i, t in enumerate(texts)]
    docs = documents(rows, extra=("part", "file", "offset"))
    _, _, got = read(spark, docs, length=64)
    ordered = sorted(((i, t) for i, t, _, _ in rows), key=lambda r: r[0])
    assert sorted(map(tuple, got)) == wanted_rows(library, ordered)


def test_null_and_repeated_ids_and_empty_table(spark, documents, library):
    rows = [(None, "x", "en", "s"), (3, "same", "en", "s"), (3, "same", "en", "s"), (3, "other", "en", "s"), (4, None, "en", "s")]
    _, _, got = read(spark, documents(rows))
    lengths = {t: len(plain(library, t)) + 1 for t in ("x", "same", "other", None)}
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3, 3, 3, 4]
    assert sorted(r.n_tokens for r in got[1:4]) == sorted([lengths["same"]] * 2 + [lengths["other"]])
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert read(spark, documents(rows).limit(0))[2] == []


def test_sequences_are_views_of_the_mapped_file(spark, documents, library):
    texts = some_texts(300, 3)
    folder, index, _ = read(spark, documents([(i, t, "en", "s") for i, t in enumerate(texts)]).coalesce(1), length=16)
    assert index.count() == 300
    for (file,) in index.select("file").distinct().collect():
        before = pa.total_allocated_bytes()
        opened = token_files.SequenceFile(f"{folder}/files/{file}")
        assert {b.num_rows for b in opened.batches[:-1]} <= {token_files.BATCH_SEQUENCES}
        grown = pa.total_allocated_bytes() - before
        assert grown < 64 * len(opened), "mapped files are not read into memory"
        spans = [(c.buffers()[-1].address, c.buffers()[-1].size) for b in opened.batches for c in (b.column(0).values, b.column(1).values)]
        docs = opened.docs.to_pylist()
        flat = np.concatenate([opened.ids(i) for i in range(len(opened))])
        masks = pa.concat_arrays([opened.mask(i) for i in range(len(opened))]).to_pylist()
        for i in (0, len(opened) - 1):
            view, mask = opened.ids(i), opened.mask(i)
            assert len(view) == len(mask) == 16 and not view.flags.owndata and not view.flags.writeable
            for address in (view.ctypes.data, mask.buffers()[1].address):
                assert any(a <= address < a + n for a, n in spans)
        for d in docs:
            ids = flat[d["start"] : d["start"] + d["n_tokens"]].tolist()
            assert ids == [*plain(library, texts[d["doc_id"]]), 2]
            assert np.concatenate(opened.document(d["start"], d["n_tokens"])).tolist() == ids
        known = sum(d["n_tokens"] for d in docs)
        assert masks == [True] * known + [False] * (-known % 16)


def test_unnamed_files_are_not_read(spark, documents):
    """A lost attempt's files beside the committed ones change nothing."""
    folder, index, got = read(spark, documents([(i, f"text {i}", "en", "s") for i in range(10)]))
    with open(f"{folder}/files/part-000000-lost.tokens.arrow", "wb") as file:
        file.write(b"cut off")
    assert sorted(map(tuple, token_files.read_token_files(index, folder).collect())) == sorted(map(tuple, got))
