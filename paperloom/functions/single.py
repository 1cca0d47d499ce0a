"""Bound values within expressions, and column functions for one text at a time, through the session at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often make uses it.

    try_element_at knows its type once; get would work it out for each row, through all that is nested in make.
    """
    return F.try_element_at(F.transform(F.array(value), make), F.lit(1))


#: Stand before and after a match; in the text itself another control character takes their place.
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"


def pieces(text: Column, form: str) -> Column:
    """A text cut before each match of a regular expression, for match_of and behind: the first piece has no match.

    One look finds the matches and what is between them, and cutting by one character spares compiling the expression for
    each text. Control characters in the text change places one for one, so the form must not tell them apart.
    """
    plain = F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text)
    return F.split(F.regexp_replace(plain, form, f"{_OPEN}$0{_CLOSE}"), _OPEN)


def match_of(piece: Column) -> Column:
    return F.substring_index(piece, _CLOSE, 1)


def behind(piece: Column) -> Column:
    """What stands behind a piece's match; the first piece is all that."""
    return F.substring_index(piece, _CLOSE, -1)


def of_text(make: Callable[[Column], Column], text: str | None):
    """What a column function makes of one text, as plain Python."""
    from paperloom.session import build_session

    spark = SparkSession.getActiveSession() or build_session()
    return spark.range(1).select(make(F.lit(text).cast("string")).alias("x")).first()["x"]
