"""JSON inside free text: validity, and the object in a model's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_space

# Where to look for JSON in an answer, in this order; the whole text comes last.
_FENCED_JSON = r"(?s)```json\n?(.*?)\n?```"
_FENCED = r"(?s)```\n?(.*?)\n?```"
_BRACES = r"(?s)\{.*\}"

# Stands behind a candidate in a list of two. A parser that stops early never gets to it.
_SENTINEL = "\u241f end of candidate \u241f"


def one_value(text: Column) -> Column:
    """The text as a VARIANT if the whole of it is one JSON value, else NULL.

    Spark's JSON parser stops after the first value and accepts what follows. The
    text is parsed once, as the first of a list of two: anything that follows its
    value either breaks the list, or closes it early, or moves the second element.
    """
    def check(listed: Column) -> Column:
        whole = F.try_variant_get(listed, "$[1]", "string") == _SENTINEL
        return F.when(whole, F.try_variant_get(listed, "$[0]", "variant"))

    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{_SENTINEL}"]')))
    return F.when(~F.contains(text, F.lit(_SENTINEL)), let(parsed, check))


def is_json(text: Column) -> Column:
    """The whole text is one JSON value."""
    return F.coalesce(one_value(text).isNotNull(), F.lit(False))


def _found(text: Column, braces: bool) -> Column:
    """``struct<text, value>`` of the first candidate that parses.

    A candidate is cut out and parsed only when those before it fail.
    """
    def valid(candidate: Column) -> Column:
        def keep(c: Column) -> Column:
            return let(one_value(c), lambda value: F.when(value.isNotNull(), F.struct(c.alias("text"), value.alias("value"))))

        return let(trim_space(candidate), keep)

    def search(t: Column) -> Column:
        fenced = [F.when(F.contains(t, F.lit("```")), F.regexp_extract(t, pattern, 1)) for pattern in (_FENCED_JSON, _FENCED)]
        inner = [F.when(F.contains(t, F.lit("}")), F.regexp_extract(t, _BRACES, 0))] if braces else []
        return F.coalesce(*map(valid, (*fenced, *inner, t)))

    return let(text, search)


def json_block(text: Column, braces: bool = True) -> Column:
    """The first candidate that parses: fenced as json, fenced, outermost braces, all.

    Without ``braces`` an object inside other text is not looked for.
    """
    return _found(text, braces)["text"]


def json_value(text: Column, braces: bool = True) -> Column:
    """The same as a VARIANT, from the parse that found it valid."""
    return _found(text, braces)["value"]


def _is(value: Column, *kinds: str) -> Column:
    return F.schema_of_variant(value).rlike("^(?:" + "|".join(kinds) + ")")


def _text(value: Column, path: str) -> Column:
    """A field as text, whatever it holds; NULL where it is absent or null."""
    field = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.try_variant_get(value, path, "string"), F.when(_is(field, "OBJECT", "ARRAY"), F.to_json(field)))


def _number(value: Column, path: str) -> Column:
    """A field that is a number; a text of digits is none."""
    return F.when(_is(F.try_variant_get(value, path, "variant"), "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(value, path, "double"))


def _item(value: Column, path: str) -> Column:
    item = F.struct(_text(value, f"{path}.name").alias("name"), _number(value, f"{path}.price").alias("price"))
    return F.when(_is(F.try_variant_get(value, path, "variant"), "OBJECT"), item)


def parse_hours(text: Column) -> Column:
    """``struct<happy_hours, confidence>``; no list and ``low`` where absent."""
    def build(value: Column) -> Column:
        listed = F.try_variant_get(value, "$.happy_hours", "array<variant>")
        entries = F.transform(listed, lambda e: F.when(_is(e, "OBJECT"), F.struct(_text(e, "$.day").alias("day"), _text(e, "$.times").alias("times"))))
        whole = F.forall(listed, lambda e: F.coalesce(_is(e, "OBJECT", "VOID"), F.lit(True)))
        return F.struct(
            F.coalesce(F.when(whole, entries), F.array().cast("array<struct<day: string, times: string>>")).alias("happy_hours"),
            F.coalesce(_text(value, "$.confidence"), F.lit("low")).alias("confidence"),
        )

    return let(json_value(text), build)


def parse_menu(text: Column) -> Column:
    """``struct<drink, food, short_summary>``; NULL items and an empty summary where absent."""
    def build(value: Column) -> Column:
        return F.struct(
            _item(value, "$.drink").alias("drink"), _item(value, "$.food").alias("food"),
            F.coalesce(_text(value, "$.short_summary"), F.lit("")).alias("short_summary"),
        )

    return let(json_value(text), build)
