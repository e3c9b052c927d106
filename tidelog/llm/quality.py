"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Each rule bounds the quotient of two measures of a text. All measures are built-in expressions
on arrays of one row, so nothing is shuffled and a text of any length stays in its task.

Cases: a NULL text counts as empty, has all measures 0 and fails the rule on length. Repeated
rows are judged one by one. Input columns may have any names: they travel in one struct.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.words import SEPARATOR_CHARS, SEPARATORS, split_words, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# The commonest function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with was on be by this are from or an at "
    "de la le les et des en un une du que qui dans par pour sur est au avec "
    "der die und den von zu das mit sich auf für ist im nicht ein eine als auch "
    "el los las y del se con una por su para es lo como al"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects texts of at least `min_words` whose `measure` / `per` is below low or above high."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    min_words: int = 0

    def fails(self) -> Column:
        value, unit = F.col(self.measure), F.col(self.per) if self.per else F.lit(1)
        checks = []
        if self.low is not None:
            checks.append(value * 100 < unit * F.lit(self.low * 100))
        if self.high is not None:
            checks.append(value * 100 > unit * F.lit(self.high * 100))
        failed = checks[0] if len(checks) == 1 else checks[0] | checks[1]
        return (F.col("n_words") >= self.min_words) & failed if self.min_words else failed


BASE_RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.30),
)
METHOD_RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=25.0, min_words=20),
    Rule("symbols", "n_symbols", "n_words", high=0.30, min_words=20),
    Rule("stop_words", "n_stop_words", "n_words", low=0.03, min_words=40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.40, min_words=20),
)
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
)


def _repeated_words(grams: Column, width: int) -> Column:
    """Words covered by windows whose hash stands twice or more in the array of hashes."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    equal_next = F.zip_with(
        pairs,
        F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1))),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(
            F.array().cast("array<int>")
        ),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(equal_next)))
    gaps = F.zip_with(
        starts,
        F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))),
        lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)),
    )
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap).cast("bigint")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input row as struct `row`, and the measures of its text."""
    text = text_or_empty(F.col(text_col))
    length = F.length("_t")
    rows = docs.select(F.struct("*").alias("row"), text.alias("_t"))
    rows = rows.select(
        "row",
        length.alias("_chars"),
        split_words(F.col("_t")).alias("_words"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.translate("_t", SYMBOLS, "")).alias("_plain"),
        F.length(F.translate("_t", SEPARATOR_CHARS, "")).alias("word_chars"),
    )
    rows = rows.select(
        "row",
        F.size("_words").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        (F.col("_chars") - F.col("_plain")).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    hashes = F.col("_hashes")
    grams = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
            lambda i: F.xxhash64(*(hashes[i + j] for j in range(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*(c for c in rows.columns if c != "_hashes"), grams.alias("_grams"))
    some_repeat = F.size(F.array_distinct("_grams")) < F.size("_grams")
    repeated = F.when(some_repeat, _repeated_words(F.col("_grams"), WINDOW)).otherwise(F.lit(0))
    # A filter on a verdict would otherwise be moved below all this, with every measure written
    # out in place of its name; it cannot pass a column that is not deterministic.
    return rows.select(
        "row",
        *(repeated.cast("bigint").alias(m) if m == "n_repeat_words" else m for m in MEASURES),
        F.monotonically_increasing_id().alias("_place"),
    )


def judge(measured: DataFrame, rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """Adds base_failed, kept and the names of the failed rules to measured rows."""
    base = (F.col("_place") < 0) | BASE_RULES[0].fails()
    for rule in BASE_RULES[1:]:
        base = base | rule.fails()
    table = (*BASE_RULES, *rules)
    names = F.array_compact(F.array(*(F.when(r.fails(), F.lit(r.name)) for r in table)))
    return measured.select(
        "*", base.alias("base_failed"), F.concat_ws(",", names).alias("failed_rules")
    ).select("*", ((F.col("failed_rules") == "") & (F.col("_place") >= 0)).alias("kept"))


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=METHOD_RULES
) -> DataFrame:
    """One row per document: its id, measures, base_failed, kept and failed rules."""
    judged = judge(measure(docs, text_col), rules)
    return judged.select(
        F.col(f"row.{id_col}").alias(id_col), *MEASURES, "base_failed", "failed_rules", "kept"
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules=METHOD_RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return judge(measure(docs, text_col), rules).filter("kept").select("row.*")
