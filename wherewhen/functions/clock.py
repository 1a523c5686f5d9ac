"""Clock texts such as ``3pm``, ``15:00`` or ``3:00 p.m.``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, digits_to_int, let, plain_marks, squeeze_space

# The clock forms that are understood.
_CLOCK_24 = r"^([0-9]{1,2}):([0-9]{2})\z"
_CLOCK_12 = rf"(?i)^([0-9]{{1,2}})(?::([0-9]{{2}}))?{SPACE}*(am|pm|a\.m\.|p\.m\.)"
_EITHER = rf"(?is)^([0-9]{{1,2}})(?::([0-9]{{2}}))?{SPACE}*(am|pm|a\.m\.|p\.m\.|\z).*\z"
_MINUTES = rf"(?i)([0-9]+):([0-9]+){SPACE}*(AM|PM)"
_HALF_DAY = r"(?i)(am|pm)"


def canonical_clock(c: Column) -> Column:
    """``H:MM AM/PM`` where the text is a clock time, else the squeezed text.

    A bare ``3:00`` counts as a 24-hour time, so it becomes ``3:00 AM``.
    """

    def shape(t: Column) -> Column:
        hour = digits_to_int(F.regexp_extract(t, _CLOCK_24, 1))
        twelve = F.when(hour == 0, 12).when(hour > 12, hour - 12).otherwise(hour)
        from_24 = F.concat(
            twelve.cast("string"), F.lit(":"), F.regexp_extract(t, _CLOCK_24, 2),
            F.when(hour >= 12, " PM").otherwise(" AM"),
        )
        minute = F.coalesce(F.nullif(F.regexp_extract(t, _CLOCK_12, 2), F.lit("")), F.lit("00"))
        from_12 = F.concat(
            digits_to_int(F.regexp_extract(t, _CLOCK_12, 1)).cast("string"), F.lit(":"), minute,
            F.when(F.regexp_extract(t, _CLOCK_12, 3).rlike("(?i)^a"), " AM").otherwise(" PM"),
        )
        return F.when(hour <= 23, from_24).when(t.rlike(_CLOCK_12), from_12).otherwise(t)

    return let(squeeze_space(plain_marks(c)), shape)


def clock_minutes(c: Column) -> Column:
    """Minutes from midnight of the first ``H:MM AM/PM`` in the text, or NULL."""

    def read(t: Column) -> Column:
        hour = digits_to_int(F.regexp_extract(t, _MINUTES, 1))
        minute = digits_to_int(F.regexp_extract(t, _MINUTES, 2))
        late = F.lower(F.regexp_extract(t, _MINUTES, 3)) == "pm"
        of_day = F.when(late & (hour != 12), hour + 12).when(~late & (hour == 12), 0).otherwise(hour)
        return of_day * 60 + minute

    return let(c, read)


def clock_minutes_or_zero(c: Column) -> Column:
    """As ``clock_minutes``, but midnight for a text that is not a clock time."""
    return F.coalesce(clock_minutes(c), F.lit(0))


def flexible_minutes(c: Column) -> Column:
    """Minutes of the text once brought into canonical form; 0 when unreadable.

    Equal to ``clock_minutes_or_zero(canonical_clock(c))`` for a text trimmed
    and with plain marks, but one pattern reads both clock forms and the
    canonical text is never built. That is most of the work of a schedule scan.
    """

    def read(parts: Column) -> Column:
        half = F.lower(F.get(parts, F.lit(2)))
        minute = F.coalesce(digits_to_int(F.get(parts, F.lit(1))), F.lit(0))
        return F.transform(
            F.array(digits_to_int(F.get(parts, F.lit(0)))),
            lambda hour: F.when(
                half == "",
                F.when((F.get(parts, F.lit(1)) != "") & (hour <= 23), hour * 60 + minute).otherwise(0),
            )
            .when(F.startswith(half, F.lit("p")) & (hour != 12), hour * 60 + minute + 720)
            .when(F.startswith(half, F.lit("a")) & (hour == 12), minute)
            .otherwise(hour * 60 + minute),
        )[0]

    return F.when(
        c.rlike("^[0-9]"),
        let(
            F.split(F.regexp_replace(c, _EITHER, "$1\u0001$2\u0001$3"), "\u0001"),
            lambda parts: F.when(F.size(parts) == 3, read(parts)).otherwise(clock_minutes_or_zero(c)),
        ),
    ).otherwise(clock_minutes_or_zero(c))


def names_half_day(c: Column) -> Column:
    return c.rlike(_HALF_DAY)


def inherit_half_day(start: Column, end: Column) -> Column:
    """Give the start of a range the AM/PM of its end when it has none."""
    return F.when(
        ~names_half_day(start) & names_half_day(end),
        F.concat(start, F.lit(" "), F.regexp_extract(end, _HALF_DAY, 1)),
    ).otherwise(start)


def within(start: Column, end: Column, minute: Column) -> Column:
    """Inclusive on both ends; a range that ends before it starts passes midnight."""
    return F.when(end < start, (minute >= start) | (minute <= end)).otherwise(
        (minute >= start) & (minute <= end)
    )
