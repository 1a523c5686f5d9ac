"""The composed directory query, its counters and summaries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_MILES
from ..functions.text import filled, not_blank
from .proximity import first_rows, nearest_first, with_distance
from .schedule import SCHEDULE, active_column


@dataclass(frozen=True)
class Filters:
    """What a visitor can set. The weekday and hour only matter through ``as_of``."""

    search: str = ""
    neighborhood: str | None = None
    has_schedule: bool = False
    active_now: bool = False


def matches(filters: Filters, as_of: datetime | str | Column, column: str = SCHEDULE) -> Column:
    """All set filters as one condition, the cheap ones first."""
    test = F.lit(True)
    if filters.search:
        wanted = F.lower(F.lit(filters.search))
        test = test & (
            F.contains(F.lower("restaurant_name"), wanted) | F.contains(F.lower("address"), wanted)
        )
    if filters.neighborhood:
        test = test & (F.col("neighborhood") == filters.neighborhood)
    if filters.has_schedule:
        test = test & not_blank(F.col(column))
    if filters.active_now:
        test = test & active_column(column, as_of)
    return F.coalesce(test, F.lit(False))


def directory_query(
    places: DataFrame, filters: Filters, as_of: datetime | str | Column, near: tuple[float, float] | None = None,
    order: str = "ord", by_name: bool = False, limit: int | None = None,
) -> DataFrame:
    """Filtered places in file order, by name, or nearest first.

    With ``near`` the rows get a ``distance`` in miles, and rows without a
    position come last in file order.
    """
    chosen = places.filter(matches(filters, as_of))
    if near is not None:
        return nearest_first(with_distance(chosen, near, radius=EARTH_MILES), [order], limit)
    return first_rows(chosen, ["restaurant_name", order] if by_name else [order], limit)


def result_counters(places: DataFrame, filters: Filters, as_of: datetime | str | Column) -> DataFrame:
    """Rows shown, rows with a schedule over all rows, rows active among those shown."""
    shown = matches(filters, as_of)
    return places.agg(
        F.count_if(shown).alias("shown"),
        F.count_if(not_blank(F.col(SCHEDULE))).alias("with_schedule"),
        F.count_if(shown & active_column(SCHEDULE, as_of)).alias("active"),
    )


def summary(places: DataFrame) -> DataFrame:
    """Totals and shares in percent; NULL shares for an empty directory."""
    def percent(condition: Column) -> Column:
        return F.round(F.try_divide(F.count_if(condition) * 100, F.count("*")), 1)

    with_schedule, with_menu = filled(F.col(SCHEDULE)), filled(F.col("menu_summary"))
    return places.agg(
        F.count("*").alias("total"),
        F.count_if(with_schedule).alias("with_schedule"), percent(with_schedule).alias("schedule_percent"),
        F.count_if(with_menu).alias("with_menu"), percent(with_menu).alias("menu_percent"),
    )


def sample_first(places: DataFrame, order: str, n: int = 5) -> DataFrame:
    """Those of the first ``n`` rows that have a menu summary."""
    return first_rows(places, [order], n).filter(filled(F.col("menu_summary")))


def fetch_totals(places: DataFrame) -> DataFrame:
    return places.agg(F.count("*").alias("total"), F.count_if(filled(F.col(SCHEDULE))).alias("with_schedule"))
