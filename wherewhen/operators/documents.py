"""Place documents: categories, flattening and paged search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_METERS, great_circle
from ..functions.text import strict_double
from ..schema import DROP_CATEGORIES, FIRST_KEYWORDS, KEEP_CATEGORIES, MORE_KEYWORDS
from .keyed import first_per_key

PAGE_SIZE = 20


def _is_happy(entry: Column) -> Column:
    return F.upper(entry["secondaryHoursType"]) == "HAPPY_HOUR"


def listed_schedule(entries: Column) -> Column:
    """Lines of the first entry of the wanted type that has lines, else NULL."""
    usable = F.filter(
        entries, lambda e: _is_happy(e) & (F.coalesce(F.size(e["weekdayDescriptions"]), F.lit(0)) > 0)
    )
    return F.array_join(F.get(usable, F.lit(0))["weekdayDescriptions"], " | ")


def has_listed_schedule(entries: Column) -> Column:
    """Some entry has the wanted type, with or without lines."""
    return F.coalesce(F.exists(entries, _is_happy), F.lit(False))


def is_excluded(types: Column, confirmed: Column | None = None) -> Column:
    """All categories rule the place out and none keeps it.

    Confirmed places and places without categories stay.
    """
    low = F.transform(types, F.lower)
    keep = F.array(*[F.lit(v) for v in KEEP_CATEGORIES])
    drop = F.array(*[F.lit(v) for v in DROP_CATEGORIES])
    out = (F.size(types) > 0) & ~F.arrays_overlap(low, keep) & (F.size(F.array_except(low, drop)) == 0)
    out = F.coalesce(out, F.lit(False))
    return out if confirmed is None else out & ~confirmed


def exclude_categories(documents: DataFrame) -> DataFrame:
    return documents.filter(
        ~is_excluded(F.col("types"), has_listed_schedule(F.col("currentSecondaryOpeningHours")))
    )


def flatten_places(documents: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One place row per document; absent texts are empty, and so are zero counts."""

    def text(path: str) -> Column:
        return F.coalesce(F.col(path).cast("string"), F.lit(""))

    def number(path: str) -> Column:
        value = F.col(path).cast("string")
        return F.when(value.rlike(r"^-?0*\.?0*(?:[eE].*)?\z"), "").otherwise(F.coalesce(value, F.lit("")))

    schedule = F.coalesce(listed_schedule(F.col("currentSecondaryOpeningHours")), F.lit(""))
    return documents.select(
        text("displayName.text").alias("restaurant_name"),
        text("formattedAddress").alias("address"),
        text("nationalPhoneNumber").alias("phone_number"),
        text("websiteUri").alias("website_url"),
        schedule.alias("happy_hour_times"),
        F.coalesce(F.array_join("regularOpeningHours.weekdayDescriptions", " | "), F.lit("")).alias("regular_hours"),
        number("rating").alias("rating"),
        number("userRatingCount").alias("review_count"),
        text("priceLevel").alias("price_level"),
        F.when(schedule != "", "Google Places API (Happy Hours)").otherwise("Google Places API").alias("source"),
        F.lit("").alias("freshness_date"),
        text("location.latitude").alias("latitude"),
        text("location.longitude").alias("longitude"),
        text("id").alias("place_id"),
        text("googleMapsUri").alias("google_maps_url"),
        F.lit("").alias("generative_summary"),
        F.lit(None).cast("string").alias("cheapest_drink"),
        F.lit(None).cast("double").alias("cheapest_drink_price"),
        F.lit(None).cast("string").alias("cheapest_food"),
        F.lit(None).cast("double").alias("cheapest_food_price"),
        F.lit(None).cast("string").alias("menu_summary"),
        F.lit(None).cast("string").alias("menu_url"),
        *(carry or []),
    )


def documents_within(
    documents: DataFrame, at: tuple[float, float], meters: float, keep_missing: bool = True
) -> DataFrame:
    """Radius filter on the nested position."""
    lat, lng = strict_double(F.col("location.latitude")), strict_double(F.col("location.longitude"))
    near = great_circle(F.lit(at[0]), F.lit(at[1]), lat, lng, EARTH_METERS) <= meters
    return documents.filter(F.coalesce(near, F.lit(keep_missing)))


def capped_hits(results: DataFrame, cap: int = 60) -> DataFrame:
    """Search hits as far as a source pages: ``cap`` per cell and keyword, in whole pages of 20 at most."""
    pages = -(-cap // PAGE_SIZE)
    order = ["page", "pos", "place_id"]
    return first_per_key(results.filter(F.col("page") < pages), ["cell_id", "keyword"], order, limit=cap)


def gap_keywords(keywords: list[str] | None = None, used: list[str] = FIRST_KEYWORDS) -> Column:
    """Keywords not searched yet, in their order."""
    asked = keywords if keywords is not None else FIRST_KEYWORDS + MORE_KEYWORDS
    return F.array_except(F.array(*[F.lit(k) for k in asked]), F.array(*[F.lit(k) for k in used]))
