"""Token counts through a cache of digests: only texts never counted before are encoded.

The cache is an append-only Parquet table (version, digest, n_tokens). The version is a digest of
the tokenizer's file and of the way it is called, the digest is that of a text's content after
normalisation (NULL counts as empty; nothing else may change, or the count would). A run

1. takes the digest of every text,
2. keeps one text of each digest (first within tasks, then across) that the cache lacks,
3. encodes these and appends their counts to the cache,
4. joins the documents' digests to the counts.

Texts are shuffled once, without their copies. Where the tokenizer's own rules part a text at a
space between two other characters, a part's count does not depend on its neighbours; each
worker remembers a bounded number of such parts, short ones only.

Cases: NULL and empty texts have no bytes and no tokens; copies share a count; two runs at once
may append the same digest twice, which reading evens out; an empty table appends nothing.
"""

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.batches import in_pieces
from tidelog.llm.words import text_or_empty, utf8_bytes

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
OPTIONS = "no special tokens added, no truncation, no padding"
# Most parts a worker remembers, characters of the longest of them, and bytes of text it works on at once.
REMEMBERED = 300_000
LONGEST_PART = 64
PIECE_BYTES = 4 << 20
_OTHER_SPACE = re.compile(r"[^\S \n]")
_PART = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the options it is used with."""
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read())
    content.update(OPTIONS.encode())
    return content.hexdigest()


class PartCounter:
    """Counts tokens of texts, part by part.

    A space between two other characters always begins a new unit of a byte-level pattern, and a
    line feed between two such characters is a unit of its own; texts with other white space or
    runs of it are parted at single spaces alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def _count_all(self, parts: list[str]) -> list[int]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [len(e.ids) for e in encode(parts, add_special_tokens=False)]

    @staticmethod
    def parts(text: str) -> list[str]:
        if not text:
            return []
        plain = text[0] not in " \n" and text[-1] not in " \n" and not _OTHER_SPACE.search(text)
        if plain and not any(run in text for run in ("  ", "\n\n", " \n", "\n ")):
            lines = text.split("\n")
            found = []
            for line in lines:
                first, *rest = line.split(" ")
                found.append(first)
                found.extend([" " + word for word in rest])
            found.extend(["\n"] * (len(lines) - 1))
            return found
        first, *rest = _PART.split(text)
        return [first, *(" " + part for part in rest)]

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.parts(text) for text in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*split)
        todo = list(new)
        self.known.update(zip(todo, self._count_all(todo), strict=True))
        look_up = self.known.__getitem__
        counted = [sum(map(look_up, parts)) for parts in split]
        for part in todo:
            if len(part) > LONGEST_PART:
                del self.known[part]
        return counted


def _encode(path: str, version: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PartCounter(path)
        for batch in in_pieces(batches, "text", PIECE_BYTES):
            counts = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([version] * batch.num_rows, pa.string()),
                    batch.column("digest"),
                    pa.array(counts, pa.int64()),
                ],
                ["version", "digest", "n_tokens"],
            )

    return run


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Digests with their counts for one tokenizer version; no folder is an empty cache."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(folder).filter(F.col("version") == version)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_folder: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens and over_limit; fills the cache."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = text_or_empty(F.col(text_col))
    texts = docs.select(text.alias("text")).select(
        F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), "text"
    )
    known = read_cache(spark, cache_folder, version)
    missing = texts.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    missing.mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(
        cache_folder
    )
    counted = read_cache(spark, cache_folder, version)
    keys = docs.select(
        F.col(id_col),
        utf8_bytes(F.col(text_col)).alias("n_bytes"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
    )
    return keys.join(counted, "digest").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
