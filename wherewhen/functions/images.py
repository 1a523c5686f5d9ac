"""Image references of a page with the text around them.

The one place where rows go through Python: the context of an image needs match
offsets and full entity decoding, which Spark's expressions do not have. The
helper only lists references; choosing among them stays in the DataFrame.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tags import attributes, start_tag

_MARKUP = re.compile(r"<[^>]+>")

# How much text around an image counts as its context.
CONTEXT_CHARS = 160
REFERENCE_TYPE = T.ArrayType(T.StructType([
    T.StructField("raw", T.StringType()), T.StructField("descriptor", T.StringType()),
    T.StructField("context", T.StringType()),
]))

# Pages without any of these hold no reference and skip the Python worker.
MAY_HAVE_IMAGES = r"(?i)<(?:img|source|meta)\b|url\("

# Elements and attributes that name one image, or a list of them.
ELEMENTS = ["img", "source", "meta"]
ONE_IMAGE = {"src", "data-src", "data-lazy-src", "data-original", "content"}
IMAGE_LIST = {"srcset", "data-srcset"}

_ELEMENT = re.compile(start_tag(ELEMENTS))
# The url token of CSS: quoted, or bare.
_STYLE_URL = re.compile(r"""url\(\s*(?:"([^"]*)"|'([^']*)'|([^\s"'()]+))\s*\)""", re.I)


class Reference(NamedTuple):
    """An image address as written. References are read in the order of these fields."""

    style: bool  # elements come before style sheets
    start: int
    listed: bool  # an element's own image comes before its lists
    end: int
    text: str


def _element_references(page: str) -> Iterator[Reference]:
    for tag in _ELEMENT.finditer(page):
        for name, value in attributes(tag.group()):
            if name in ONE_IMAGE or name in IMAGE_LIST:
                listed = name in IMAGE_LIST
                for text in value.split(",") if listed else [value]:
                    yield Reference(False, tag.start(), listed, tag.end(), text)


def _style_references(page: str) -> Iterator[Reference]:
    for token in _STYLE_URL.finditer(page):
        yield Reference(True, token.start(), False, token.end(), next(filter(None, token.groups()), ""))


def _references(page: str) -> list[dict]:
    ordered = sorted(chain(_element_references(page), _style_references(page)), key=lambda r: r[:3])
    rows = []
    for ref in ordered:
        address, _, descriptor = entities.unescape(ref.text).strip().partition(" ")
        if address:
            context = page[max(0, ref.start - CONTEXT_CHARS) : ref.end + CONTEXT_CHARS]
            rows.append({"raw": address, "descriptor": descriptor.strip(), "context": _MARKUP.sub(" ", context)})
    return rows


@F.pandas_udf(REFERENCE_TYPE)
def _reference_column(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(lambda page: _references(page) if page else [])


def image_references(html: Column) -> Column:
    return _reference_column(html)
