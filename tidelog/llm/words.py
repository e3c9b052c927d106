"""Words of a text as Spark columns.

A word is a run of characters other than space and the ASCII controls 9 to 13. Bytes of UTF-8
above 127 are never separators, so the same rule holds on bytes.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[\x20\x09-\x0D]"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def split_words(text: Column) -> Column:
    """Array of the words of a text; NULL has none."""
    return F.array_remove(F.split(text_or_empty(text), SEPARATORS + "+"), "")


def count_words(text: Column) -> Column:
    return F.size(split_words(text)).cast("bigint")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text_or_empty(text)).cast("bigint")
