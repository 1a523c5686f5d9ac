"""Display projections of place columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, iso_date

# Price levels and their signs.
PRICE_SIGNS = {
    "PRICE_LEVEL_INEXPENSIVE": "$",
    "PRICE_LEVEL_MODERATE": "$$",
    "PRICE_LEVEL_EXPENSIVE": "$$$",
    "PRICE_LEVEL_VERY_EXPENSIVE": "$$$$",
}


def price_sign(level: Column) -> Column:
    chain = F
    for name, sign in PRICE_SIGNS.items():
        chain = chain.when(level == name, sign)
    return chain.otherwise("")


def local_phone(phone: Column) -> Column:
    return F.coalesce(F.regexp_replace(phone, r"^\+1\s*", ""), F.lit(""))


def source_label(source: Column) -> Column:
    """Case-sensitive and ordered: the map service wins over the website."""
    return (
        F.when(~filled(source), "Unknown")
        .when(source.contains("google") | source.contains("Google"), "Google Maps")
        .when(
            source.contains("website") | source.contains("Website") | source.contains("AI"), "Website"
        )
        .otherwise(source)
    )


def short_address(address: Column, city: str = "San Diego") -> Column:
    """Drop the first ``, <city>, CA 9xxxx`` and a trailing ``, CA``."""
    tail = rf"(?i)^(.*?),\s*\Q{city}\E,?\s*(?:CA)?\s*[0-9]{{5}}(?:-[0-9]{{4}})?"
    no_city = F.regexp_replace(address, tail, "$1")
    return F.coalesce(F.trim(F.regexp_replace(no_city, r"(?i),\s*CA\s*\z", "")), F.lit(""))


def date_label(c: Column) -> Column:
    """``Apr 19, 2026``; the date as stored, empty when there is none."""
    return F.coalesce(F.date_format(iso_date(c), "MMM d, yyyy"), F.lit(""))


def marker_status(has_schedule: Column, active: Column) -> Column:
    return F.when(active, "Active now").when(has_schedule, "Not active now").otherwise("No Happy Hour")
