"""Registered queries against their SQL, and the pipeline against the operators' own results."""

import glob
import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tidelog.llm import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr
    )


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    result = db.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.collect(), df.columns) == ordered(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_has_a_row_per_input_row(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    if name.startswith("op4_"):
        n = len([i for (i,) in duckdb.execute(f"SELECT vec_id FROM '{sf_dir}/embeddings.parquet' WHERE vec_id % 50 = 0").fetchall()])
        assert len(rows) == 5 * n
        return
    table, key = ("pages", "page_id") if name.startswith("op7_") else ("documents", "doc_id")
    ids = [r[0] for r in duckdb.execute(f"SELECT {key} FROM '{sf_dir}/{table}.parquet'").fetchall()]
    assert sorted(r[key] for r in rows) == sorted(ids)


def test_pipeline(spark, sf_dir):
    """Each stage works on what the one before has kept; the last one's digests are checked anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.schema, docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).checkpoint()
        assert kept.schema == columns
        counts.append(kept.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for r in kept.collect():
        ids = model.encode(r.text, add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((r.doc_id, len(ids), digest, hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
