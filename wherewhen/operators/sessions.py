"""Schedules parsed once, and asked at any number of instants.

A directory repeats its schedule texts, so a text is parsed once: the distinct
texts are dealt out by hash, parsed there, and what they say is joined back by
hash and text. Rows of a crowded text are split by Spark where the dictionary is
not broadcast anyway; a row without a text joins nothing.

Parsing explodes entries and sessions into rows, where Spark compiles every
expression; no lambda is interpreted. ``write_sessions`` keeps the result: a
table of sessions by weekday, so that a question reads one weekday's files.

Many instants are one interval-stabbing join (``active_pairs``). Instants fall on
one of the 10,080 minutes of a week, a bounded table that is broadcast with the
coarse slot each minute lies in; sessions are minute intervals, cut in two where
they pass midnight, and filed under the slots they touch. No session is shuffled
to meet an instant, so no slot is crowded. Where only counts are asked for
(``active_sweep``), sessions are added up per aligned piece of a day instead.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions import schedule as sched
from ..functions.text import not_blank, trim_space

SCHEDULE = "happy_hour_times"
DAY_MINUTES = 1440
SLOT_MINUTES = 180
DAY_LEVELS = 11  # 2^11 minutes hold a day


def distinct_texts(places: DataFrame, column: str = SCHEDULE) -> DataFrame:
    """``text_hash, text`` of the schedule texts that say anything, and ``n_places`` that have each.

    Grouped by text alone: a join by hash and text then exchanges both sides, and
    Spark can split a crowded text among the places.
    """
    grouped = places.where(not_blank(F.col(column))).groupBy(F.col(column).alias("text")).agg(F.count("*").alias("n_places"))
    return grouped.select(F.xxhash64("text").alias("text_hash"), "text", "n_places")


def join_texts(places: DataFrame, said: DataFrame, column: str = SCHEDULE, how: str = "left") -> DataFrame:
    """Places beside what is said of their text; ``said`` has ``text_hash`` and ``text`` and loses them."""
    right = said.withColumnsRenamed({"text_hash": "__text_hash", "text": "__text"})
    left = places.withColumn("__hash", F.xxhash64(column))
    same = (left["__hash"] == right["__text_hash"]) & (left[column] == right["__text"])
    return left.join(right, same, how).drop("__hash", "__text_hash", "__text")


def for_each_text(places: DataFrame, columns: dict[str, Column], column: str = SCHEDULE) -> DataFrame:
    """Adds columns that are expressions over the column ``text``, each computed once per distinct text.

    They are NULL where the schedule is blank.
    """
    said = distinct_texts(places, column).select("text_hash", "text", *[c.alias(n) for n, c in columns.items()])
    return join_texts(places, said, column)


def entry_rows(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """One row per entry that has a body: keys, entry_ord, day_raw, day_idx, closed, body."""
    split = texts.where(not_blank(F.col(column))).select(
        *keys, F.posexplode(F.split(sched.clean_schedule(F.col(column)), sched.ENTRY_SEPARATOR)).alias("entry_ord", "__entry")
    )
    parts = split.select(
        *keys, "entry_ord", F.substring_index("__entry", ":", 1).alias("__head"),
        trim_space(sched.entry_body(F.col("__entry"))).alias("body"),
    ).where(F.col("body") != "")
    day = trim_space(F.col("__head"))
    return parts.select(
        *keys, "entry_ord", day.alias("day_raw"), sched.day_index(day).alias("day_idx"),
        (F.lower("body") == "closed").alias("closed"), "body",
    )


def session_rows(entries: DataFrame, keys: list[str], strict_minutes: bool = False) -> DataFrame:
    """One row per usable session and per closed entry, with minutes in the flexible reading (``start_min0``, ``end_min0``).

    ``strict_minutes`` adds ``start_min`` and ``end_min``, which are NULL for a
    clock text that cannot be read.
    """
    kept = [*keys, "entry_ord", "day_raw", "day_idx", "closed"]
    split = entries.select(
        *kept, F.posexplode_outer(F.when(~F.col("closed"), F.split("body", ", "))).alias("session_ord", "__session")
    ).select(*kept, "session_ord", F.split("__session", " - ").alias("__halves"))
    usable = split.where(F.col("closed") | (F.size("__halves") == 2)).select(
        *kept, "session_ord", *[trim_space(F.get("__halves", F.lit(i))).alias(n) for i, n in enumerate(("start_txt", "end_txt"))]
    )
    whole = usable.withColumn("__start", clock.inherit_half_day(F.col("start_txt"), F.col("end_txt")))
    read = lambda c: F.when(~F.col("closed"), clock.flexible_minutes(F.col(c)))
    out = whole.withColumns({"start_min0": read("__start"), "end_min0": read("end_txt")})
    if strict_minutes:
        out = out.withColumns({
            "start_min": clock.clock_minutes(clock.canonical_clock(F.col("__start"))),
            "end_min": clock.clock_minutes(clock.canonical_clock(F.col("end_txt"))),
        })
    return out.drop("__start").withColumn("wraps", F.col("end_min0") < F.col("start_min0"))


def parsed_sessions(places: DataFrame, column: str = SCHEDULE) -> DataFrame:
    """Sessions of the distinct texts: text_hash, text, n_places and the columns of ``session_rows``."""
    keys = ["text_hash", "text", "n_places"]
    return session_rows(entry_rows(distinct_texts(places, column), keys), keys)


# --- a stored table ------------------------------------------------------------

def write_sessions(places: DataFrame, path: str, column: str = SCHEDULE) -> None:
    """Parse a directory's schedules once and keep the sessions, in folders by weekday.

    A weekday's sessions are spread over files by text; entries without a weekday
    are kept too, under the default partition.
    """
    sessions = parsed_sessions(places, column)
    sessions.repartition("day_idx", F.pmod("text_hash", F.lit(64))).write.mode("errorifexists").partitionBy("day_idx").parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def instant_of(as_of: datetime | str) -> tuple[int, int]:
    """Weekday (0 = Sunday) and minute of the day."""
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return moment.isoweekday() % 7, moment.hour * 60 + moment.minute


def active_texts(sessions: DataFrame, as_of: datetime | str, carry_to_next_day: bool = False) -> DataFrame:
    """``text_hash, text`` of the schedules with a session that covers the instant; reads one weekday, two if carried."""
    day, minute = instant_of(as_of)
    start, end, wraps = F.col("start_min0"), F.col("end_min0"), F.col("wraps")
    if carry_to_next_day:
        before = (day + 6) % 7
        today = (F.col("day_idx") == day) & (minute >= start) & (wraps | (minute <= end))
        covers = F.col("day_idx").isin(day, before) & (today | ((F.col("day_idx") == before) & wraps & (minute <= end)))
    else:
        covers = (F.col("day_idx") == day) & clock.within(start, end, F.lit(minute))
    return sessions.where(~F.col("closed") & covers).groupBy("text").agg(F.first("text_hash").alias("text_hash"))


def active_places(
    places: DataFrame, as_of: datetime | str, sessions: DataFrame | None = None, column: str = SCHEDULE,
    carry_to_next_day: bool = False,
) -> DataFrame:
    """Places with a session that covers the instant, from stored ``sessions`` or those of the places' texts."""
    parsed = parsed_sessions(places, column) if sessions is None else sessions
    return join_texts(places, active_texts(parsed, as_of, carry_to_next_day), column, "left_semi")


# --- many instants -------------------------------------------------------------

def week_minutes(instants: DataFrame, at: str) -> DataFrame:
    """The distinct ``day_idx, minute`` of instants: 10,080 rows at most."""
    day, minute = F.dayofweek(at) - 1, F.hour(at) * 60 + F.minute(at)
    return instants.where(F.col(at).isNotNull()).select(day.cast("int").alias("day_idx"), minute.cast("int").alias("minute")).distinct()


def session_intervals(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day_idx, first, last: minutes covered, in one piece, or two of a session that passes midnight.

    Minutes after midnight count for the session's own weekday, as everywhere in
    the flexible reading.
    """
    start, end = F.col("start_min0"), F.col("end_min0")
    piece = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    pieces = F.when(F.col("wraps"), F.array(piece(F.lit(0), end), piece(start, F.lit(DAY_MINUTES - 1)))).otherwise(F.array(piece(start, end)))
    usable = sessions.where(~F.col("closed") & F.col("day_idx").isNotNull())
    return usable.select(*keys, "day_idx", F.inline(pieces))


def stabbed(intervals: DataFrame, minutes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, day_idx, minute`` of every interval that covers a minute, once for each key.

    Minutes are a bounded table, so they are what is broadcast, hashed by weekday
    and slot; an interval meets the minutes of the slots it touches.
    """
    slots = F.sequence(F.floor(F.col("first") / SLOT_MINUTES), F.floor(F.col("last") / SLOT_MINUTES))
    filed = intervals.where("first <= last").select(*keys, "day_idx", "first", "last", F.explode(slots).alias("slot"))
    asked = minutes.withColumn("slot", F.floor(F.col("minute") / SLOT_MINUTES))
    met = filed.join(F.broadcast(asked), ["day_idx", "slot"])
    return met.where(F.col("minute").between(F.col("first"), F.col("last"))).select(*keys, "day_idx", "minute").distinct()


def places_by_hour(places: DataFrame, column: str = SCHEDULE, sessions: DataFrame | None = None) -> DataFrame:
    """``day_idx, hour, n_active`` for the full hours of a week, where any place is active; each place counts once an hour."""
    parsed = parsed_sessions(places, column) if sessions is None else sessions
    pieces = session_intervals(parsed, ["text", "n_places"])
    first, last = F.ceil(F.col("first") / 60).cast("int"), F.floor(F.col("last") / 60).cast("int")
    said = pieces.select("text", "n_places", "day_idx", F.explode(F.when(first <= last, F.sequence(first, last))).alias("hour")).distinct()
    return said.groupBy("day_idx", "hour").agg(F.sum("n_places").alias("n_active"))


def disjoint(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The same minutes, each in one interval of its key only: an interval begins behind those before it."""
    before = Window.partitionBy(*keys, "day_idx").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("last").over(before) + 1, F.lit(0))
    cut = intervals.withColumn("__reached", reached).withColumn("first", F.greatest("first", "__reached"))
    return cut.drop("__reached").where("first <= last")


def dyadic_pieces(intervals: DataFrame) -> DataFrame:
    """Each interval as the aligned pieces of length 1, 2, 4, ... it is made of, two of a length at most: ``level``, ``node``."""
    level = intervals.select("*", F.explode(F.sequence(F.lit(0), F.lit(DAY_LEVELS))).alias("level"))
    whole = lambda n: (  # noqa: E731 - first and last whole piece of a level
        F.expr(f"cast(ceil(first / double(shiftleft(1, level + {n}))) as int)"),
        F.expr(f"shiftright(last + 1, level + {n}) - 1"),
    )
    (low, high), (above, upto) = whole(0), whole(1)
    ends = level.select("*", low.alias("__low"), high.alias("__high"), above.alias("__above"), upto.alias("__upto")).where("__low <= __high")
    node = F.explode(F.array_distinct(F.array("__low", "__high")))
    pieces = ends.withColumn("node", node).where("NOT shiftright(node, 1) BETWEEN __above AND __upto")
    return pieces.drop("__low", "__high", "__above", "__upto", "first", "last")


def active_sweep(places: DataFrame, instants: DataFrame, at: str, key: str, column: str = SCHEDULE, sessions: DataFrame | None = None) -> DataFrame:
    """Instants with ``n_active`` places and the least ``key`` among them (``first_active``), 0 and NULL if there is none.

    Sessions are those of the places' texts, or ``sessions`` if they are stored.
    No pair of a place and an instant is made: sessions are cut into aligned
    pieces of the day, added up per piece in a table of at most 7 x 4,095 rows,
    and a minute adds up the 12 pieces it lies in.
    """
    parsed = parsed_sessions(places, column) if sessions is None else sessions
    owners = places.where(not_blank(F.col(column))).groupBy(F.col(column).alias("text")).agg(F.count("*").alias("n"), F.min(key).alias("least"))
    minutes = week_minutes(instants, at)
    single = disjoint(session_intervals(parsed, ["text_hash", "text"]), ["text"])
    owned = single.join(owners.withColumn("text_hash", F.xxhash64("text")), ["text_hash", "text"])
    pieces = dyadic_pieces(owned.select("day_idx", "first", "last", "n", "least"))
    sums = pieces.groupBy("day_idx", "level", "node").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    levels = minutes.select("*", F.explode(F.sequence(F.lit(0), F.lit(DAY_LEVELS))).alias("level"))
    counts = levels.withColumn("node", F.expr("shiftright(minute, level)")).join(sums, ["day_idx", "level", "node"]).groupBy("day_idx", "minute").agg(
        F.sum("n").alias("n_active"), F.min("least").alias("first_active")
    )
    asked = instants.withColumns({"__day": (F.dayofweek(at) - 1).cast("int"), "__minute": (F.hour(at) * 60 + F.minute(at)).cast("int")})
    answers = counts.withColumnsRenamed({"day_idx": "__its_day", "minute": "__its_minute"})
    same = (asked["__day"] == answers["__its_day"]) & (asked["__minute"] == answers["__its_minute"])
    joined = asked.join(F.broadcast(answers), same, "left")  # 10,080 rows at most
    return joined.drop("__day", "__minute", "__its_day", "__its_minute").withColumn("n_active", F.coalesce("n_active", F.lit(0)))


def active_pairs(places: DataFrame, instants: DataFrame, at: str, keys: list[str], column: str = SCHEDULE, sessions: DataFrame | None = None) -> DataFrame:
    """Every instant beside every place active then: the columns of ``instants`` and ``keys`` of places."""
    parsed = parsed_sessions(places, column) if sessions is None else sessions
    active = stabbed(session_intervals(parsed, ["text_hash", "text"]), week_minutes(instants, at), ["text_hash", "text"])
    owners = places.where(not_blank(F.col(column))).select(*keys, F.xxhash64(column).alias("text_hash"), F.col(column).alias("text"))
    at_minutes = owners.join(active, ["text_hash", "text"]).select(*keys, "day_idx", "minute")
    asked = instants.withColumns({"day_idx": (F.dayofweek(at) - 1).cast("int"), "minute": (F.hour(at) * 60 + F.minute(at)).cast("int")})
    return at_minutes.join(asked, ["day_idx", "minute"]).select(*instants.columns, *keys)
