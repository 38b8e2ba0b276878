"""Column expressions that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ends a word: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_between(text: Column, separators: str) -> Column:
    """Words of ``text`` (null: none) with an empty string before and after them, so that word i stands at index i, from 1."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), separators)


def word_count(text: Column, separators: str = SPACE) -> Column:
    """Number of words of ``text`` as a long; 0 for null."""
    return (F.size(words_between(text, separators)) - 2).cast("long")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and no other letters, in lower case; the faster way where all of it is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def same_row(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Join condition on ``keys`` that takes nulls as equal; by it no filter on nulls gets between a table and its exchange."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition
