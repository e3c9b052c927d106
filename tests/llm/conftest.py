import pytest


@pytest.fixture
def documents(spark):
    """Makes a table of documents with columns that clash with names used inside."""

    def make(rows, extra=("row", "id", "words", "size")):
        full = [(i, t, lang, source, None if t is None else len(t), *(f"{c}{i}" for c in extra)) for i, t, lang, source in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        schema += "".join(f", {c} string" for c in extra)
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf_dir():
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
