"""Encoding by prefix table and cached counts against the tokenizers' own libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidelog.llm import pieces, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

ODD = ["", " ", "  ", " \n", "a", "▁ ▁x", "a <s> </s> <unk> <0x41> b", "é ö ß 日本語 🙂 ก", "x\x00y", "﻿a​"]
ODD += [" " * 700, "a" * 4000, "ab" * 2000, " " * 33 + "x", "don't we'll I'd\r\n\tthe\u0085end \x1c x", "1,234.5 (a)."]
ODD += ["<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "<|startoftext|>x"]


def random_texts(seed, alphabet, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


ALPHABET = [*" \n\t▁abcdeé日本<s>ﬁ​🙂ก.,'!#|0129", "the", "ing", " on", "er", "  ", "<|endoftext|>", "\r\n", " "]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PIECES)


def test_prefix_table_equals_the_library(model, library):
    texts = ODD + random_texts(1, ALPHABET, 4000, 60)
    vocabulary = [p.replace("▁", " ") for p in model.ids]
    texts += random_texts(2, vocabulary, 4000, 8)
    for text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text).tolist() == ids, repr(text)
        assert model.decode(ids) == library.decode(ids), repr(text)


def test_prefixes_not_merging_give_the_ids(model, monkeypatch):
    """With the direct merging taken away, only runs of spaces fail."""
    fresh = pieces.PieceModel(PIECES)
    fresh._steps(model.ids["▁the"])
    monkeypatch.setattr(pieces, "REMEMBERED_WORDS", 3)
    texts = ["The quick brown fox, jumped over 12 lazy dogs.", "unbelievably long-winded words words"]
    expected = [model.encode(t).tolist() for t in texts]
    assert [fresh.encode(t).tolist() for t in texts] == expected


def test_unknown_control_and_broken_bytes(model, library):
    for ids in ([], [1, 2], [1, 0, 2], [model.byte_ids[0xC3], model.byte_ids[0xA9]]):
        if 0 not in ids:
            assert model.decode(ids) == library.decode(ids)


def test_encoded_documents(documents, library):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(None, None, None, None), (0, ODD[4], "en", "s")]
    got = pieces.encode_and_decode(documents(rows), PIECES).collect()
    assert len(got) == len(rows)
    texts = {(i, t) for i, t, _, _ in rows}
    for r in got:
        assert r.n_tokens == len(r.ids) and (r.ids[0], r.ids[-1]) == (1, 2)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert any(r.ids == library.encode(t or "", add_bos=True, add_eos=True) for i, t in texts if i == r.doc_id)


def test_parts_count_like_whole_texts():
    from tokenizers import Tokenizer

    counter = token_counts.PartCounter(BYTES)
    own = Tokenizer.from_file(BYTES)
    texts = ODD + random_texts(3, ALPHABET, 8000, 40)
    expected = [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts) == expected


def test_forgotten_parts(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counter = token_counts.PartCounter(BYTES)
    first = counter.counts(["one two three four five six seven", "one two"])
    assert first == counter.counts(["one two three four five six seven", "one two"])


def test_long_words_are_not_remembered():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["中" * 5000 + f" short {i} " + "x" * 3000 for i in range(4)]
    counter, own = token_counts.PartCounter(BYTES), Tokenizer.from_file(BYTES)
    assert counter.counts(texts) == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(map(len, counter.known)) <= token_counts.LONGEST_PART
    model, library = pieces.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts:
        assert model.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert max(map(len, model.words)) <= pieces.LONGEST_WORD


def test_cache_is_filled_once(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(50, None, None, None)] + [(60 + i, "same text", "en", "s") for i in range(20)]
    first = token_counts.count_tokens(documents(rows), BYTES, cache, limit=5)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTES)
    for r, t in [(r, dict((i, t) for i, t, _, _ in rows)[r.doc_id]) for r in first.collect()]:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 5)
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t, _, _ in rows})
    assert stored.count() == distinct == stored.select("digest").distinct().count()
    more = [*rows, (100, "another text", "en", "s")]
    assert token_counts.count_tokens(documents(more), BYTES, cache).count() == len(more)
    assert spark.read.parquet(cache).count() == distinct + 1


def test_versions_do_not_mix(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    version = token_counts.tokenizer_version(BYTES)
    digest = hashlib.sha256(b"x y z").digest()
    rows = [("other version", digest, 99), (version, hashlib.sha256(b"known").digest(), 42)] * 2
    spark.createDataFrame(rows, token_counts.CACHE_SCHEMA).write.parquet(cache)
    docs = documents([(1, "x y z", "en", "s"), (2, "known", "en", "s")])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTES, cache).collect()}
    assert got == {1: 3, 2: 42}


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.count_tokens(docs, BYTES, str(tmp_path / "c")).count() == 0
    assert pieces.encode_and_decode(docs, PIECES).count() == 0
    assert pieces.encode_and_decode(docs, PIECES, with_texts=False).filter(F.col("n_tokens") > 0).count() == 0
