"""Weekly schedule texts such as ``Monday: 3 - 6 PM | Tuesday: Closed``.

Three readings exist side by side and disagree on purpose:

* *display* (``normalized_schedule``) repairs as much as it can;
* *flexible* (``flexible_entries``/``flexible_sessions``) decides what is active now;
* *strict* (``strict_entries``) is the structured form, two sessions at most.

All of them are expressions over one text column. A place stays one row, so
asking who is active needs neither an explode nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import (
    canonical_clock, clock_minutes, flexible_minutes, inherit_half_day, within,
)
from .text import SPACE_CHARS, let, not_blank, plain_marks, squeeze_space, trim_space

# Weekday names, Sunday first, and the six status codes with labels.
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
STATUS_LABELS = {
    "ACTIVE": "Happy Hour Now",
    "LATER_TODAY": "Happy Hour Later",
    "NO_HAPPY_HOUR": "No Happy Hour",
    "NO_HAPPY_HOUR_TODAY": "No Happy Hour Today",
    "CLOSED_TODAY": "Closed Today",
    "PASSED_TODAY": "Happy Hour Ended",
}

ENTRY_SEPARATOR = r" \| "
_GLUED_DAY = r"(?i)(?<=[a-z0-9])(?=(?:" + "|".join(DAYS) + r"):)"
_LINE_END = r"[\n\r\u2028\u2029]"
_TAG = r"<[^>]+>"


def clean_schedule(c: Column) -> Column:
    """Plain blanks and hyphens, and a separator before a glued-on day name."""
    return F.regexp_replace(plain_marks(c), _GLUED_DAY, " | ")


def day_index(c: Column) -> Column:
    """0 for Sunday to 6 for Saturday, NULL when the text is no weekday."""
    names = F.array(*[F.lit(d.lower()) for d in DAYS])
    return F.nullif(F.array_position(names, F.lower(c)), F.lit(0)).cast("int") - 1


def day_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in DAYS]), index)


def entry_body(e: Column) -> Column:
    """What stands behind ``day:``, with blanks in front removed; NULL unless it is there and on one line.

    A text of blanks only counts as there, and gives an empty body.
    """
    colon = F.instr(e, ":")
    rest = F.substr(e, colon + 1)
    body = F.ltrim(rest, F.lit(SPACE_CHARS))
    return F.when((colon > 1) & (rest != "") & ~body.rlike(_LINE_END) & ((body != "") | ~rest.rlike(_LINE_END + r"\z")), body)


# --- flexible reading -------------------------------------------------------

def flexible_entries(c: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<entry_ord, day_raw, day_idx, closed, body>>``.

    Entries that do not look like ``day: text`` keep their place with an empty
    body and no day. With ``wanted``, a condition on the weekday index, other
    entries are put aside before any of the costlier parsing.
    """
    texts = F.split(clean_schedule(c), ENTRY_SEPARATOR)
    if wanted is not None:
        texts = F.filter(texts, lambda e: wanted(day_index(trim_space(F.substring_index(e, ":", 1)))))
    parts = F.transform(
        texts,
        lambda e, i: F.struct(
            i.alias("entry_ord"),
            F.substring_index(e, ":", 1).alias("head"),
            entry_body(e).alias("body"),
        ),
    )
    named = F.transform(
        parts,
        lambda p: F.struct(
            p["entry_ord"].alias("entry_ord"),
            F.when(p["body"].isNull(), "").otherwise(trim_space(p["head"])).alias("day_raw"),
            F.coalesce(trim_space(p["body"]), F.lit("")).alias("body"),
        ),
    )
    return F.transform(
        named,
        lambda p: F.struct(
            p["entry_ord"].alias("entry_ord"),
            p["day_raw"].alias("day_raw"),
            day_index(p["day_raw"]).alias("day_idx"),
            (F.lower(p["body"]) == "closed").alias("closed"),
            p["body"].alias("body"),
        ),
    )


def flexible_sessions(body: Column) -> Column:
    """``array<struct<session_ord, usable, start_txt, end_txt, start_min, end_min>>``.

    A session is usable when it is exactly two texts around `` - ``. Clock
    texts that cannot be read count as midnight here; ``strict`` minutes keep
    NULL instead.
    """
    halves = F.transform(
        F.split(body, ", "),
        lambda s, i: F.struct(i.alias("session_ord"), F.split(s, " - ").alias("halves")),
    )
    texts = F.transform(
        halves,
        lambda x: F.struct(
            x["session_ord"].alias("session_ord"),
            (F.size(x["halves"]) == 2).alias("usable"),
            trim_space(F.get(x["halves"], F.lit(0))).alias("start_txt"),
            trim_space(F.get(x["halves"], F.lit(1))).alias("end_txt"),
        ),
    )
    return F.transform(
        texts,
        lambda x: F.struct(
            x["session_ord"].alias("session_ord"),
            x["usable"].alias("usable"),
            x["start_txt"].alias("start_txt"),
            x["end_txt"].alias("end_txt"),
            F.when(x["usable"], flexible_minutes(inherit_half_day(x["start_txt"], x["end_txt"]))).alias("start_min"),
            F.when(x["usable"], flexible_minutes(x["end_txt"])).alias("end_min"),
        ),
    )


def is_active(c: Column, day: Column, minute: Column, carry_to_next_day: bool = False) -> Column:
    """Does some session of ``day`` cover ``minute``?

    After-midnight minutes of a session that passes midnight belong to the
    session's own weekday. ``carry_to_next_day`` moves them to the day after.
    Only entries of the day asked for have their clock texts read.
    """
    if not carry_to_next_day:
        hit = F.exists(
            flexible_entries(c, lambda index: index == day),
            lambda e: (e["day_idx"] == day) & ~e["closed"] & F.exists(
                flexible_sessions(e["body"]),
                lambda s: s["usable"] & within(s["start_min"], s["end_min"], minute),
            ),
        )
    else:
        before = (day + 6) % 7
        hit = F.exists(
            flexible_entries(c, lambda index: index.isin(day, before)),
            lambda e: e["day_idx"].isin(day, before) & ~e["closed"] & F.exists(
                flexible_sessions(e["body"]),
                lambda s: s["usable"] & F.when(
                    e["day_idx"] == day,
                    (minute >= s["start_min"])
                    & ((s["end_min"] < s["start_min"]) | (minute <= s["end_min"])),
                ).otherwise((s["end_min"] < s["start_min"]) & (minute <= s["end_min"])),
            ),
        )
    return F.when(not_blank(c), F.coalesce(hit, F.lit(False))).otherwise(False)


def status_code(c: Column, day: Column, minute: Column) -> Column:
    """One of the six status codes at an instant.

    Active looks at every session of the day; the other codes look only at the
    first session of the first entry for the day.
    """

    def today(entries: Column) -> Column:
        return F.struct(
            F.transform(
                F.filter(entries, lambda e: e["day_idx"] == day),
                lambda e: F.struct(
                    e["closed"].alias("closed"), flexible_sessions(e["body"]).alias("sessions")
                ),
            ).alias("entries"),
            F.exists(entries, lambda e: ~e["closed"] & (e["body"] != "")).alias("offers_any"),
        )

    def decide(state: Column) -> Column:
        active = F.exists(
            state["entries"],
            lambda e: ~e["closed"] & F.exists(
                e["sessions"], lambda s: s["usable"] & within(s["start_min"], s["end_min"], minute)
            ),
        )
        first = F.get(state["entries"], F.lit(0))
        session = F.get(first["sessions"], F.lit(0))
        return (
            F.when(active, "ACTIVE")
            .when(first["closed"], "CLOSED_TODAY")
            .when(session["usable"] & (minute < session["start_min"]), "LATER_TODAY")
            .when(session["usable"] & (minute > session["end_min"]), "PASSED_TODAY")
            .when(state["offers_any"], "NO_HAPPY_HOUR_TODAY")
            .otherwise("NO_HAPPY_HOUR")
        )

    return F.when(not_blank(c), let(let(flexible_entries(c), today), decide)).otherwise(
        "NO_HAPPY_HOUR"
    )


def status_label(code: Column) -> Column:
    chain = F
    for name, label in STATUS_LABELS.items():
        chain = chain.when(code == name, label)
    return chain.otherwise("")


# --- strict reading ---------------------------------------------------------

def _strict_range(text: Column) -> Column:
    """The two ends of ``a - b``; NULL unless there are exactly two."""
    halves = F.split(trim_space(text), " - ")
    return F.when(F.size(halves) == 2, F.transform(halves, trim_space))


def strict_entries(c: Column) -> Column:
    """``array<struct<entry_ord, day, start, end, second, start2, end2>>``.

    Closed entries have empty times. Entries whose first session is not a
    range are dropped, whatever follows. There is no AM/PM inheritance.
    """
    parts = F.transform(
        F.split(clean_schedule(c), ENTRY_SEPARATOR),
        lambda e, i: F.struct(i.alias("entry_ord"), F.split(e, ": ").alias("kv")),
    )
    named = F.transform(
        parts,
        lambda p: F.struct(
            p["entry_ord"].alias("entry_ord"),
            F.get(p["kv"], F.lit(0)).alias("day"),
            F.get(p["kv"], F.lit(1)).alias("body"),
            F.split(F.get(p["kv"], F.lit(1)), ", ").alias("pieces"),
        ),
    )
    named = F.filter(named, lambda p: (p["day"] != "") & (p["body"] != ""))
    ranged = F.transform(
        named,
        lambda p: F.struct(
            p["entry_ord"].alias("entry_ord"),
            trim_space(p["day"]).alias("day"),
            (F.lower(p["body"]) == "closed").alias("closed"),
            _strict_range(F.get(p["pieces"], F.lit(0))).alias("one"),
            F.when(F.size(p["pieces"]) >= 2, _strict_range(F.get(p["pieces"], F.lit(1)))).alias("two"),
            (F.size(p["pieces"]) >= 2).alias("second"),
        ),
    )
    kept = F.filter(ranged, lambda p: p["closed"] | p["one"].isNotNull())

    def part(p: Column, side: str, index: int) -> Column:
        return F.when(p["closed"], "").otherwise(
            F.coalesce(F.get(p[side], F.lit(index)), F.lit(""))
        )

    parsed = F.transform(
        kept,
        lambda p: F.struct(
            p["entry_ord"].alias("entry_ord"),
            p["day"].alias("day"),
            part(p, "one", 0).alias("start"),
            part(p, "one", 1).alias("end"),
            (~p["closed"] & p["second"]).alias("second"),
            part(p, "two", 0).alias("start2"),
            part(p, "two", 1).alias("end2"),
        ),
    )
    return F.when(not_blank(c), parsed).otherwise(F.slice(parsed, 1, 0))


def _strict_day(c: Column, name: Column) -> Column:
    """First strict entry for a weekday name, compared with its case."""
    return F.get(F.filter(strict_entries(c), lambda e: e["day"] == name), F.lit(0))


def is_active_strict(c: Column, day: Column, minute: Column) -> Column:
    entry = F.filter(strict_entries(c), lambda e: e["day"] == day_name(day))

    def covers(start: Column, end: Column) -> Column:
        return F.coalesce(within(clock_minutes(start), clock_minutes(end), minute), F.lit(False))

    return F.coalesce(
        F.exists(
            F.slice(entry, 1, 1),
            lambda e: (e["start"] != "") & (
                covers(e["start"], e["end"]) | (e["second"] & covers(e["start2"], e["end2"]))
            ),
        ),
        F.lit(False),
    )


def _session_text(e: Column) -> Column:
    return F.concat(
        e["start"], F.lit(" - "), e["end"],
        F.when(
            e["second"] & (e["start2"] != ""),
            F.concat(F.lit(", "), e["start2"], F.lit(" - "), e["end2"]),
        ).otherwise(""),
    )


def rendered_schedule(c: Column, blank_label: str = "No happy hour info") -> Column:
    """The strict reading as text; raw text when nothing could be read."""
    entries = strict_entries(c)
    lines = F.transform(
        entries,
        lambda e: F.when(e["start"] == "", F.concat(e["day"], F.lit(": Closed"))).otherwise(
            F.concat(e["day"], F.lit(": "), _session_text(e))
        ),
    )
    return (
        F.when(~not_blank(c), blank_label)
        .when(F.size(entries) == 0, c)
        .otherwise(F.array_join(lines, " | "))
    )


def day_schedule(c: Column, day: Column) -> Column:
    """Sessions of one weekday in the strict reading; empty when closed or absent."""
    entry = _strict_day(c, day_name(day))
    return F.coalesce(F.when(entry["start"] != "", _session_text(entry)), F.lit(""))


# --- display reading --------------------------------------------------------

def _display_session(s: Column) -> Column:
    plain = squeeze_space(F.regexp_replace(s, "-+", " - "))
    halves = F.transform(F.array(plain), lambda t: F.struct(t.alias("text"), F.split(t, " - ").alias("halves")))

    def build(x: Column) -> Column:
        start = trim_space(F.get(x["halves"], F.lit(0)))
        end = trim_space(F.get(x["halves"], F.lit(1)))
        return F.when(
            F.size(x["halves"]) == 2,
            F.concat(canonical_clock(inherit_half_day(start, end)), F.lit(" - "), canonical_clock(end)),
        ).otherwise(x["text"])

    return F.get(F.transform(halves, build), F.lit(0))


def normalized_schedule(c: Column) -> Column:
    """Canonical schedule text for display; empty for blank or marked-up text."""
    text = F.regexp_replace(clean_schedule(c), r"([apAP][mM])-+([0-9])", "$1 - $2")
    entries = F.filter(
        F.transform(F.split(text, ENTRY_SEPARATOR), trim_space), lambda e: e != ""
    )
    split = F.transform(
        entries,
        lambda e: F.struct(
            e.alias("entry"),
            trim_space(F.regexp_extract(e, r"(?s)^(.*?): (.*)\z", 1)).alias("day"),
            trim_space(F.regexp_extract(e, r"(?s)^(.*?): (.*)\z", 2)).alias("body"),
        ),
    )
    lines = F.transform(
        split,
        lambda p: F.when((p["day"] == "") | (p["body"] == ""), p["entry"])
        .when(F.lower(p["body"]) == "closed", F.concat(p["day"], F.lit(": Closed")))
        .otherwise(
            F.concat(
                p["day"], F.lit(": "),
                F.array_join(F.transform(F.split(p["body"], ", "), _display_session), ", "),
            )
        ),
    )
    return F.when(not_blank(c) & ~c.rlike(_TAG), F.array_join(lines, " | ")).otherwise("")


def display_line(c: Column, day: Column) -> Column:
    """First display line that begins with a weekday name, or empty."""
    name = F.lower(day_name(day))
    lines = F.split(normalized_schedule(c), ENTRY_SEPARATOR)
    return F.coalesce(
        F.get(F.filter(lines, lambda line: F.startswith(F.lower(line), name)), F.lit(0)), F.lit("")
    )


def schedule_from_items(items: Column) -> Column:
    """Schedule text from ``array<struct<day, times>>``; blank parts are skipped."""
    kept = F.filter(items, lambda i: (i["day"] != "") & (i["times"] != ""))
    return F.array_join(
        F.transform(kept, lambda i: F.concat(i["day"], F.lit(": "), i["times"])), " | "
    )


def hour_label(hour: Column) -> Column:
    """``0`` is ``12:00 AM``, ``13`` is ``1:00 PM``."""
    h = hour.cast("string")
    return (
        F.when(hour == 0, "12:00 AM")
        .when(hour < 12, F.concat(h, F.lit(":00 AM")))
        .when(hour == 12, "12:00 PM")
        .otherwise(F.concat((hour - 12).cast("string"), F.lit(":00 PM")))
    )
