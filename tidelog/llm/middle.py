"""Fill-in-the-middle transformation of texts by counted quantifiers.

A text is a row of units, its code points: `(?s).` matches one of them, left to right. With a
and b the smaller and the larger of two cuts, the row's own pattern

    (?s)\\A(unit{a}+)(unit{b-a}+)(.*+)\\z

has possessive groups, so that one match without any backtracking takes prefix, middle and
suffix, and the replacement puts them in the order of the form. The number of units comes from
regexp_count. It is counted in whole blocks of BLOCK units and the units of what is left: a text
never becomes an array of its characters.

The cuts and the form come from the first four 8-digit groups h1 to h4 of the SHA-256 of
`<seed>:<id>`: cuts h1 % (n+1) and h2 % (n+1); plain if h3 % 100 is not below `rate`; spm if
h4 % 100 is below `spm`, else psm. Texts that are empty or hold one of the three marks stay plain:
a mark then never stands in a transformed text but where it was put, and cannot arise where
a piece meets a mark either, since marks begin with `<`, end with `>` and hold neither inside.

Cases: a NULL text is an empty one; a NULL id counts as the empty text in the digest; repeated
rows give repeated results; long texts are matched whole, in constant extra memory beside the
copies of the text; an empty table gives an empty result; all other columns are left out or, by
`transform_documents`, kept, whatever their names.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.words import text_or_empty

# Units that are counted by one match.
BLOCK = 4096
UNIT = "."


@dataclass(frozen=True)
class Middle:
    """How texts are transformed; rate and spm are per cent."""

    seed: int = 1
    rate: int = 90
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for mark in marks:
            inner = mark[1:-1]
            if len(mark) < 3 or mark[0] != "<" or mark[-1] != ">" or not inner.isalnum():
                raise ValueError(f"a mark is <letters or digits>, not {mark!r}")
        if len(set(marks)) < 3:
            raise ValueError("the three marks must differ")


def _pattern(*pieces: Column | str) -> Column:
    return F.concat(F.lit(r"(?s)\A"), *(p if isinstance(p, Column) else F.lit(p) for p in pieces), F.lit(r"\z"))


def _taken(count: Column) -> Column:
    """A possessive group of so many units."""
    return F.concat(F.lit(f"({UNIT}{{"), count.cast("string"), F.lit("}+)"))


def _group(h: Column, number: int) -> Column:
    """One of the 8-digit groups of a hexadecimal digest, from 0, as an unsigned integer."""
    return F.conv(F.substring(h, 1 + 8 * number, 8), 16, 10).cast("bigint")


def _counted(rows: DataFrame) -> DataFrame:
    """Adds n, the units of `text`."""
    blocks = F.regexp_count("text", F.lit(f"(?s){UNIT}{{{BLOCK}}}+"))
    rows = rows.withColumn("in_blocks", blocks.cast("bigint") * BLOCK)
    rest = F.regexp_replace(F.col("text"), _pattern(_taken(F.col("in_blocks")), f"({UNIT}*+)"), F.lit("$2"))
    more = F.regexp_count(rest, F.lit(f"(?s){UNIT}"))
    return rows.withColumn("n", F.col("in_blocks") + more).drop("in_blocks")


def _restored(m: Middle) -> Column:
    """The text rebuilt from `output` and `form` alone."""
    psm = _pattern(f"{m.prefix}({UNIT}*?){m.suffix}({UNIT}*?){m.middle}({UNIT}*+)")
    spm = _pattern(f"{m.suffix}({UNIT}*?){m.prefix}({UNIT}*?){m.middle}({UNIT}*+)")
    return (
        F.when(F.col("form") == "psm", F.regexp_replace(F.col("output"), psm, F.lit("$1$3$2")))
        .when(F.col("form") == "spm", F.regexp_replace(F.col("output"), spm, F.lit("$2$3$1")))
        .otherwise(F.col("output"))
    )


def _transformed(rows: DataFrame, m: Middle) -> DataFrame:
    """Of rows with `id` and `text`: adds n, form, cuts, output and restored."""
    h = F.sha2(F.concat(F.lit(f"{m.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = _counted(rows.withColumn("text", text_or_empty(F.col("text"))).withColumn("h", h))
    first, second = (_group(F.col("h"), i) % (F.col("n") + 1) for i in (0, 1))
    marked = F.lit(False)
    for mark in (m.prefix, m.suffix, m.middle):
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | (_group(F.col("h"), 2) % 100 >= m.rate) | marked
    form = F.when(plain, "plain").when(_group(F.col("h"), 3) % 100 < m.spm, "spm").otherwise("psm")
    rows = rows.withColumns({"a": F.least(first, second), "b": F.greatest(first, second), "form": form})
    whole = _pattern(_taken(F.col("a")), _taken(F.col("b") - F.col("a")), f"({UNIT}*+)")
    order = F.when(F.col("form") == "psm", f"{m.prefix}$1{m.suffix}$3{m.middle}$2").otherwise(
        f"{m.suffix}$3{m.prefix}$1{m.middle}$2"
    )
    cut = F.col("form") != "plain"
    output = F.when(cut, F.regexp_replace(F.col("text"), whole, order)).otherwise(F.col("text"))
    return rows.withColumns(
        {
            "output": output,
            "prefix_chars": F.when(cut, F.col("a")),
            "middle_chars": F.when(cut, F.col("b") - F.col("a")),
        }
    )


def transform_texts(docs: DataFrame, how: Middle | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output and restored."""
    m = how or Middle()
    rows = _transformed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), m)
    shape = [F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output"]
    return rows.withColumn("restored", _restored(m)).select(*shape, "restored")


def transform_documents(docs: DataFrame, how: Middle | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with their texts transformed."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("whole"))
    done = _transformed(rows, how or Middle())
    return done.select(
        *(F.col("output").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns)
    )


def transformed_digests(docs: DataFrame, how: Middle | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows with digests in place of the texts."""

    def digest(text: str) -> Column:
        return F.sha2(F.encode(text, "UTF-8"), 256).alias(f"{text}_sha256")

    done = transform_texts(docs, how, id_col, text_col)
    return done.select(id_col, "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
