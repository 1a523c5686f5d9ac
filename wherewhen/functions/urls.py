"""URL columns: cleaning, joining and comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_DOTTED = r"(^|/)\.{1,2}(/|\z)"


def strip_query(url: Column) -> Column:
    """Without query, fragment and trailing slashes; the scheme in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*\z", ""), r"/+\z", "")
    scheme = F.regexp_extract(bare, _SCHEME, 1)
    return F.concat(F.lower(scheme), F.substring(bare, F.length(scheme) + 1, F.length(bare)))


def with_path(base: Column, path: str) -> Column:
    """A path put behind the base, never behind its query."""
    return F.concat(strip_query(base), F.lit(path))


def home_variants(base: Column) -> Column:
    """Home-page addresses worth trying, in order."""
    return F.when(base != "", F.array(with_path(base, "/home"), with_path(base, "/")))


def with_scheme(url: Column) -> Column:
    """Adds ``http://`` where no web scheme is given; blank is NULL."""
    trimmed = trim_space(url)
    has = F.startswith(trimmed, F.lit("http://")) | F.startswith(trimmed, F.lit("https://"))
    return F.when(url != "", F.when(has, trimmed).otherwise(F.concat(F.lit("http://"), trimmed)))


def url_key(url: Column) -> Column:
    """Sixteen hex digits that stand for a page."""
    return F.substring(F.md5(url), 1, 16)


def host(url: Column) -> Column:
    return F.regexp_extract(url, _HOST, 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def site(host_name: Column) -> Column:
    """Host in lower case without a leading ``www.``."""
    return F.regexp_replace(F.lower(host_name), r"^www\.", "")


def resolve_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; most paths have none and pass through."""
    kept = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    ends_open = p.rlike(r"(^|/)\.{1,2}\z")
    joined = F.concat(F.array_join(kept, "/"), F.when(ends_open, "/").otherwise(""))
    rooted = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(p.rlike(_DOTTED), rooted).otherwise(p)


def join_path(base_path: Column, target: Column) -> Column:
    """Path of a link target (no query) seen from a page path."""
    folder = F.regexp_replace(base_path, r"[^/]*\z", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    full = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, target))
    return resolve_dots(F.regexp_replace(full, "/{2,}", "/"))


def link_parts(base: Column, target: Column) -> Column:
    """``struct<scheme, host, path>`` of a link target seen from a page.

    Targets of another scheme (``mailto:`` and the like) have an empty host.
    """
    bare = F.regexp_replace(target, r"(?s)[?#].*\z", "")
    absolute = bare.rlike(_SCHEME)
    network = F.startswith(bare, F.lit("//"))
    return (
        F.when(absolute, F.struct(scheme(bare).alias("scheme"), host(bare).alias("host"), path(bare).alias("path")))
        .when(network, F.struct(scheme(base).alias("scheme"), host(bare).alias("host"), path(bare).alias("path")))
        .otherwise(F.struct(
            scheme(base).alias("scheme"), host(base).alias("host"), join_path(path(base), bare).alias("path")
        ))
    )
