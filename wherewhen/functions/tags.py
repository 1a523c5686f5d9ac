"""Start tags and their attributes, read after the grammar of HTML.

A start tag is ``<``, a name, attributes, ``>``; an attribute is a name, ``=``
and a quoted value. The same two patterns serve Spark's expressions and the
Python helper that lists images.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A name, an equals sign, a value in quotes of one kind.
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_ATTRIBUTE = re.compile(ATTRIBUTE)


def start_tag(names: Iterable[str]) -> str:
    """Pattern of a start tag with one of ``names``."""
    return rf"(?i)<(?:{'|'.join(names)})\b[^>]*>"


def attributes(tag: str) -> list[tuple[str, str]]:
    """Names, in lower case, and values of a start tag, in order."""
    return [(name.lower(), double or single) for name, double, single in _ATTRIBUTE.findall(tag)]


def attribute_values(tag: Column, names: Iterable[str]) -> Column:
    """Values of the attributes called ``names`` (lower case) of a start tag, in order."""
    written = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    named = F.filter(written, lambda a: F.lower(F.regexp_extract(a, ATTRIBUTE, 1)).isin(*names))
    return F.transform(named, lambda a: F.concat(F.regexp_extract(a, ATTRIBUTE, 2), F.regexp_extract(a, ATTRIBUTE, 3)))
