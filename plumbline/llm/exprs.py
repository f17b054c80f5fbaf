"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of characters that are not white space, in order."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def whole(text: Column) -> Column:
    """Null is the empty text."""
    return F.coalesce(text, F.lit(""))
