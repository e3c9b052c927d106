"""Regular expressions built from user parameters."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def comma_alternatives(terms: str, literal: bool = False) -> str:
    """`a,b` becomes the pattern `a|b`; with `literal` each term is quoted first.

    Without quoting an empty term is an empty alternative, which matches everything.
    """
    if not literal:
        return terms.replace(",", "|")
    return "|".join("\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E" for term in terms.split(","))


def named_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """Java form of a pattern with `(?P<name>...)` groups, and each group's number."""
    groups = dict(re.compile(pattern).groupindex)
    return re.sub(r"\(\?P<", "(?<", pattern), groups


def extract_groups(text: Column, pattern: str) -> dict[str, Column]:
    """One column per named group, NULL where the text does not match.

    All groups come from one replacement of the text by its first match, not from one search
    per group.
    """
    java, groups = named_groups(pattern)
    found = groups_of_match(text, java, list(groups.values()))
    return {name: F.get(found, F.lit(i)) for i, name in enumerate(groups)}


def groups_of_match(text: Column, java: str, numbers: list[int]) -> Column:
    """Some groups of a text's first match as an array, NULL where it does not match."""
    if not numbers:
        return F.when(text.rlike(java), F.array().cast("array<string>"))
    around = f"(?s)\\A.*?(?-s:{java}).*\\z"
    joined = F.regexp_replace(text, around, "\x01".join(f"${n}" for n in numbers))
    # The character that parts the groups is hardly ever in a text, which then needs a search
    # per group.
    apart = F.array(*[F.regexp_extract(text, java, n) for n in numbers])
    found = F.when(F.contains(text, F.lit("\x01")), apart).otherwise(F.split(joined, "\x01", len(numbers)))
    return F.when(text.rlike(java), found)


def map_to_json(values: Column) -> Column:
    """JSON text of a map, `{}` where there is none."""
    return F.coalesce(F.to_json(values), F.lit("{}"))


def split_list(text: Column, separator: str = ",") -> Column:
    """One row per element of a comma-separated text."""
    return F.explode(F.split(text, re.escape(separator)))
