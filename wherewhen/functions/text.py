"""String helpers with browser whitespace rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a browser counts as white space, as a trim set
# and as the inside of a Java character class.
SPACE_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACE_CLASS}]"

# Typographic spaces (with the zero-width one) and long dashes.
ODD_SPACES = (
    "\u202f\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b"
)
LONG_DASHES = "\u2013\u2014"

_NUMBER_PREFIX = rf"^{SPACE}*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Spark removes repeated sub-expressions at the top of a projection but not
    inside a lambda, where most of the schedule parsing happens.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_marks(c: Column) -> Column:
    """Typographic spaces become blanks and long dashes hyphens, in one pass."""
    return F.translate(c, ODD_SPACES + LONG_DASHES, " " * len(ODD_SPACES) + "-" * len(LONG_DASHES))


def digits_to_int(c: Column) -> Column:
    """Int of a text of digits; NULL for an empty or oversized one.

    ``try_cast`` costs an exception per bad value, which empty matches would be.
    """
    return F.when(F.length(c).between(1, 9), c).cast("int")


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze_space(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return trim_space(F.regexp_replace(c, f"{SPACE}+", " "))


def not_blank(c: Column) -> Column:
    """True when the text holds a visible character; false for NULL."""
    return F.coalesce(c.rlike(f"[^{SPACE_CLASS}]"), F.lit(False))


def filled(c: Column) -> Column:
    """NULL and the empty text are both 'no value'."""
    return F.coalesce(c != "", F.lit(False))


def trimmed_key(c: Column) -> Column:
    """Trimmed text usable as a join key; NULL when nothing is left."""
    return F.nullif(trim_space(c), F.lit(""))


def lenient_double(c: Column) -> Column:
    """Number at the start of a text, the way a browser reads one; else NULL."""
    return F.nullif(F.regexp_extract(c, _NUMBER_PREFIX, 1), F.lit("")).cast("double")


def strict_double(c: Column) -> Column:
    """The whole text has to be a number; anything else is NULL.

    The pattern keeps Spark's ``1d`` and ``1f`` suffixes out.
    """
    number = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
    return F.when(c.rlike(number), F.trim(c)).cast("double")


def iso_date(c: Column) -> Column:
    """``YYYY-MM-DD`` or NULL."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
