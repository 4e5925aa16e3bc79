"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words that no query term is.
STOP = (
    "the a an of and or to in for on is are was were be by with as at from that this what how when where which who does do did "
    "can could should would may might shall must about into than then its it their there"
).split()


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(text: Column, most: int = 12) -> Column:
    """The first distinct terms of 2 to 40 characters that are no stop words; the limit is the reference's own."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t).between(2, 40) & ~t.isin(STOP))), 1, most)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once, however often a lambda within uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
