"""Text functions with Unicode white space, and token sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(c: str | Column) -> Column:
    """Without the white space, of Unicode, at both ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def normalise_space(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def text_key(c: str | Column) -> Column:
    """The form under which two texts say the same: one case, single spaces. Folds the sharp s, as case folding does."""
    return F.replace(F.lower(normalise_space(c)), F.lit("ß"), F.lit("ss"))


def words(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def question_key(c: str | Column) -> Column:
    """The sorted set of words."""
    return F.array_sort(F.array_distinct(words(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def without(a: Column, b: Column) -> Column:
    """a less the members of b, in order, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def regexp_count(c: str | Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0)))


def escape(text: str) -> str:
    return "".join(f"\\{x}" if not x.isalnum() and x not in " _" else x for x in text)
