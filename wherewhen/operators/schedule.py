"""Who is active when: jobs over a weekly schedule column.

Asked for one instant, each distinct text is parsed once and its answer joined
back (``sessions``). Columns of instants, and the strict reading, are expressions
on the place row.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schedule as sched
from . import sessions
from .sessions import SCHEDULE


def instant_parts(as_of: datetime | str | Column) -> tuple[Column, Column]:
    """Weekday (0 = Sunday) and minute of the day of a wall-clock instant."""
    if isinstance(as_of, Column):
        return F.dayofweek(as_of) - 1, F.hour(as_of) * 60 + F.minute(as_of)
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return F.lit(moment.isoweekday() % 7), F.lit(moment.hour * 60 + moment.minute)


def instant_for(weekday: str, hour: int, today: date) -> datetime:
    """The given weekday and hour in the Sunday-based week of ``today``."""
    shift = sched.DAYS.index(weekday) - today.isoweekday() % 7
    moved = today + timedelta(days=shift)
    return datetime(moved.year, moved.month, moved.day, hour)


def instant_column(weekday: Column, hour: Column, today: Column) -> Column:
    """Column form of ``instant_for``; ``weekday`` is 0 for Sunday."""
    moved = F.date_add(today, (weekday - (F.dayofweek(today) - 1)).cast("int"))
    return moved.cast("timestamp_ntz") + F.make_dt_interval(hours=hour)


def active_column(
    column: str, as_of: datetime | str | Column, mode: str = "flexible", carry_to_next_day: bool = False
) -> Column:
    day, minute = instant_parts(as_of)
    if mode == "strict":
        return sched.is_active_strict(F.col(column), day, minute)
    if mode != "flexible":
        raise ValueError(f"unknown mode {mode!r}")
    return sched.is_active(F.col(column), day, minute, carry_to_next_day)


def active_at(
    places: DataFrame, as_of: datetime | str | Column, mode: str = "flexible",
    carry_to_next_day: bool = False, column: str = SCHEDULE,
) -> DataFrame:
    """Places with a session that covers the instant."""
    if isinstance(as_of, Column) or mode != "flexible":
        return places.filter(active_column(column, as_of, mode, carry_to_next_day))
    return sessions.active_places(places, as_of, column=column, carry_to_next_day=carry_to_next_day)


def status_at(places: DataFrame, as_of: datetime | str | Column, column: str = SCHEDULE) -> DataFrame:
    """Adds ``status`` and ``status_label``."""
    day, minute = instant_parts(as_of)
    if isinstance(as_of, Column):
        found = places.withColumn("status", sched.status_code(F.col(column), day, minute))
    else:
        found = sessions.for_each_text(places, {"status": sched.status_code(F.col("text"), day, minute)}, column)
        found = found.withColumn("status", F.coalesce("status", F.lit("NO_HAPPY_HOUR")))
    return found.withColumn("status_label", sched.status_label(F.col("status")))


def schedule_explode(places: DataFrame, keys: list[str], column: str = SCHEDULE) -> DataFrame:
    """One row per place, entry and session, in the flexible reading.

    ``start_min``/``end_min`` are NULL for a clock text that cannot be read;
    ``start_min0``/``end_min0`` follow the flexible rules (midnight instead).
    Closed entries give one row without times. ``sessions.write_sessions`` keeps
    the same rows by text, in folders by weekday.
    """
    texts = ["text_hash", "text"]
    rows = sessions.session_rows(sessions.entry_rows(sessions.distinct_texts(places, column), texts), texts, strict_minutes=True)
    out = [
        "entry_ord", "day_raw", "day_idx", "closed", "session_ord", "start_txt", "end_txt", "start_min", "end_min",
        "start_min0", "end_min0", "wraps",
    ]
    owners = places.select(*keys, F.col(column).alias("__schedule"))
    return sessions.join_texts(owners, rows, "__schedule", "inner").select(*keys, *out)


def schedule_sessions(places: DataFrame, keys: list[str], column: str = SCHEDULE) -> DataFrame:
    """One row per strict entry."""
    return places.select(*keys, F.explode(sched.strict_entries(F.col(column))).alias("e")).select(
        *keys, "e.*"
    )


def schedule_normalize(places: DataFrame, column: str = SCHEDULE, into: str = "schedule_text") -> DataFrame:
    found = sessions.for_each_text(places, {into: sched.normalized_schedule(F.col("text"))}, column)
    return found.withColumn(into, F.coalesce(into, F.lit("")))


def text_lines(places: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Pipe-separated lines as rows with their position."""
    return places.filter(F.col(column) != "").select(
        *keys, F.posexplode(F.split(F.col(column), sched.ENTRY_SEPARATOR)).alias("line_ord", "line")
    )


def weekly_occupancy(places: DataFrame, column: str = SCHEDULE) -> DataFrame:
    """Number of places active at each of the 168 full hours of a week, where any is."""
    return sessions.places_by_hour(places, column).select(
        "day_idx", "hour", sched.hour_label(F.col("hour")).alias("hour_label"), "n_active"
    )
