"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import (
    html_text,
    langid,
    licenses,
    middle,
    mixing,
    negatives,
    neighbours,
    ngram_join,
    pieces,
    quality,
    sharding,
    sql,
    token_counts,
    token_files,
)
from tidelog.session import work_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


def op2_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes")


def op3_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by their sets of three-word shingles."""
    join = ngram_join.Join(width=3, top=90, bottom=100)
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), join)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found of every fiftieth vector."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def _tokenizer(name: str) -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests."""
    return pieces.encode_and_decode(
        _table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), with_texts=False
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("findings")


def op7_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.filter(~langid.held_out()))
    predicted = langid.predict_languages(docs, model)
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), n_shards=24)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that begins empty."""
    return token_counts.count_tokens(
        _table(spark, sf_dir, "documents"),
        _tokenizer("byte_bpe_50k.json"),
        work_folder(spark, "token-cache"),
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests of every document's ids, read back from the written files."""
    folder = work_folder(spark, "token-files")
    index = token_files.write_token_files(
        _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), folder, end_id=2
    )
    return token_files.read_token_files(index, folder)


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed for filling in its middle, as digests."""
    return middle.transformed_digests(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and its positives; every seventh label is moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine_negatives(rows, F.col("id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixed_sources": op2_mixed_sources,
    "op3_ngram_components": op3_ngram_components,
    "op4_neighbours": op4_neighbours,
    "op5_piece_round_trip": op5_piece_round_trip,
    "op6_licenses": op6_licenses,
    "op7_main_texts": op7_main_texts,
    "op8_languages": op8_languages,
    "op9_shards": op9_shards,
    "op10_token_counts": op10_token_counts,
    "op11_token_files": op11_token_files,
    "op12_middle": op12_middle,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {
    "op1_quality_rules": sql.quality_sql(),
    "op2_mixed_sources": sql.mixing_sql(),
    "op3_ngram_components": sql.join_sql(),
    "op12_middle": sql.middle_sql(),
    "op13_hard_negatives": sql.negatives_sql(),
}
