"""A corpus pipeline over the table documents: each stage works on what the one before has kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import langid, mixing, ngram_join, pieces, quality
from tidelog.session import work_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told."""
    return langid.keep_languages(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four of five of its five-word shingles."""
    return ngram_join.one_of_each_component(docs, ngram_join.Join(width=5, top=80, bottom=100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as they are taken; a cut one has the words taken."""
    return mixing.mixed_documents(docs, chars_col="n_chars", weights=(1, 2, 3), most_repeats=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and its text decoded from them, as digests."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_and_decode(docs, model, with_texts=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("language ID", keep_languages),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]
# The last stage encodes with a given vocabulary, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder = work_folder(spark, "corpus")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
