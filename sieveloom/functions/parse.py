"""Lenient parsing of text cells into numbers, boxes and canonical keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, also beyond ASCII, that turns up around cells.
_BLANKS = " \t\n\r\x0b\x0c\u00a0\u3000\ufeff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(col(c), F.lit(_BLANKS))


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def number(c: Column | str) -> Column:
    """A text cell as a finite double; empty, unreadable and non-finite cells are null."""
    s = strip(c)
    v = s.try_cast("double")
    plain = F.translate(s, "0123456789.+-eE", "") == ""  # neither Java's type suffixes nor hexadecimal digits
    return F.when((F.abs(v) < F.lit(float("inf"))) & plain, v)


def lenient_float(c: Column | str) -> Column:
    """try_cast with NaN read as missing; infinities stay."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def canonical_id(c: Column | str) -> Column:
    """One spelling of an image id: case, outer blanks, ``-`` for ``_`` and an image suffix don't count."""
    s = F.regexp_replace(F.lower(strip(c)), "-", "_")
    return F.regexp_replace(s, "\\.(png|jpe?g|bmp|tiff?|gif|webp)$", "")


def canonical_class(c: Column | str) -> Column:
    """One spelling of a class name; null, empty and ``_`` are null (unknown)."""
    s = F.regexp_replace(F.lower(strip(c)), "[\\s\\u00a0-]+", "_")
    return F.when(~s.isin("", "_"), s)
