"""Keyword windows over long texts, as expressions on one text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import PYTHON_SPACE, PYTHON_SPACE_CHARS, WORD_END, WORD_START
from .text import let

# Anchors, window sizes and the tests for navigation bars and prices.
# All anchors are one alternation, so a text is scanned once, not once per anchor.
ANCHORS = [
    rf"(?i)happy(?:{PYTHON_SPACE}*|-)hour|{WORD_START}hh{WORD_END}|(?:drink|appetizer){PYTHON_SPACE}+specials?",
]
WINDOW_BEFORE = 200
WINDOW_AFTER = 4000
SHORT = 200
NAV_TOP_SHARE = 0.10
NAV_REACH = 120
PRICE_REACH = 600
NAV_BAR = rf"(?:(?:[A-Z][A-Za-z&]+|[A-Z]{{2,}}){PYTHON_SPACE}+){{3,}}(?:[A-Z][A-Za-z&]+|[A-Z]{{2,}})"
PRICE = rf"(?i)\${PYTHON_SPACE}*[0-9]+|[0-9]+{PYTHON_SPACE}*(?:bucks?|dollars?)"
PRICE_TOKEN = r"\$\s*([0-9]+(?:\.[0-9]+)?)"
STOP_WORDS = [
    "the", "and", "with", "for", "from", "a", "an", "in", "of", "or", "on", "at", "to", "by", "is", "it",
]

_INTERVALS = "array<struct<s: int, e: int>>"


def _absorb(acc: Column, s: Column, e: Column) -> Column:
    """Append an interval to sorted ones, joining it to the last when they touch."""
    last = F.element_at(acc, -1)
    joined = F.concat(
        F.slice(acc, 1, F.size(acc) - 1),
        F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], e).alias("e"))),
    )
    return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] >= s), joined).otherwise(
        F.concat(acc, F.array(F.struct(s.alias("s"), e.alias("e"))))
    )


def merge_sorted(intervals: Column) -> Column:
    """Join touching intervals of an array; reads them in order of their start."""
    return F.aggregate(
        F.array_sort(intervals), F.array().cast(_INTERVALS), lambda acc, x: _absorb(acc, x["s"], x["e"])
    )


def is_nav_anchor(text: Column, start: Column) -> Column:
    """Four capitalised words in a row around the anchor and no price after it."""
    low = F.greatest(start - NAV_REACH, F.lit(0))
    around = F.substring(text, low + 1, start + NAV_REACH - low)
    ahead = F.substring(text, start + 1, F.lit(PRICE_REACH))
    return around.rlike(NAV_BAR) & ~ahead.rlike(PRICE)


def anchor_windows(
    text: Column, pattern: str, before: int = WINDOW_BEFORE, after: int = WINDOW_AFTER
) -> Column:
    """Merged ``struct<s, e>`` windows around the matches of one pattern.

    The match offsets, which Spark does not return, are running sums over the
    matches and the text between them. Windows are joined on the way, so the
    array stays as short as the text allows windows.
    """
    size = F.length(text)

    def step(acc: Column, piece: Column) -> Column:
        start = acc["pos"] + F.length(piece["gap"])
        nav = F.when(start < size * NAV_TOP_SHARE, is_nav_anchor(text, start)).otherwise(False)
        s, e = F.greatest(start - before, F.lit(0)), F.least(size, start + after)
        return F.struct(
            (start + F.length(piece["hit"])).alias("pos"),
            F.when(nav, acc["out"]).otherwise(_absorb(acc["out"], s, e)).alias("out"),
        )

    def fold(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern), 1, F.size(hits))
        return F.aggregate(
            F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
            F.struct(F.lit(0).alias("pos"), F.array().cast(_INTERVALS).alias("out")),
            step,
            lambda acc: acc["out"],
        )

    return F.when(
        text.rlike(pattern),
        fold(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
    ).otherwise(F.array().cast(_INTERVALS))


def focus_windows(
    text: Column, patterns: list[str] | None = None, before: int = WINDOW_BEFORE, after: int = WINDOW_AFTER
) -> Column:
    """Disjoint windows over all patterns; empty when there is nothing to focus on."""
    found = [anchor_windows(text, p, before, after) for p in patterns or ANCHORS]
    merged = found[0] if len(found) == 1 else merge_sorted(F.concat(*found))
    return F.when(F.length(text) > SHORT, merged).otherwise(F.array().cast(_INTERVALS))


def focused_text(
    text: Column, patterns: list[str] | None = None, before: int = WINDOW_BEFORE, after: int = WINDOW_AFTER,
    max_out: int | None = None,
) -> Column:
    """The windows joined by blank lines; the whole text when there are none.

    ``max_out`` is the size the focused text may have, if any; the search for
    anchors covers the whole text.
    """

    def cut(windows: Column) -> Column:
        joined = F.array_join(
            F.transform(windows, lambda w: F.substring(text, w["s"] + 1, w["e"] - w["s"])), "\n\n"
        )
        short = joined if max_out is None else F.substring(joined, 1, max_out)
        return F.when(F.size(windows) > 0, short).otherwise(text)

    return let(focus_windows(text, patterns, before, after), cut)


def prices(text: Column) -> Column:
    """All dollar amounts as text, in order."""
    return F.regexp_extract_all(text, F.lit(PRICE_TOKEN), F.lit(1))


def first_price(text: Column) -> Column:
    """The number behind the first dollar sign that has one, else 0."""
    digits = F.regexp_extract(text, r"\$([0-9.]+)", 1)
    number = F.regexp_extract(digits, r"^([0-9]+\.?[0-9]*|\.[0-9]+)", 1)
    return F.coalesce(F.nullif(number, F.lit("")).cast("double"), F.lit(0.0))


def is_grounded(name: Column, text: Column) -> Column:
    """The item's name, or one of its longer words, occurs in the text."""
    bare = F.lower(F.btrim(F.regexp_replace(name, r"\$[0-9.]+", ""), F.lit(PYTHON_SPACE_CHARS)))
    body = F.lower(text)
    words = F.filter(
        F.split(bare, r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS)
    )
    return F.coalesce(
        (bare != "") & (F.contains(body, bare) | F.exists(words, lambda w: F.contains(body, w))), F.lit(False)
    )
