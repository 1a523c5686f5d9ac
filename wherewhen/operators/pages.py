"""Jobs over tables of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images as image_functions
from ..functions.markup import (
    LINK_PATH_WORDS, LINK_TEXT_WORDS, SHORT_TEXT, WORD_END, is_script_shell, needs_render, page_text, same_site_links,
)
from ..functions.text import let
from ..functions.urls import host, link_parts, path, site, strip_query, url_key
from .keyed import first_per_key, lookup
from .prune import key_bitmap, likely_rows

# Pages worth trying on any site, the telling ones and the general ones.
EXPLICIT_PATHS = [
    "/menus/happy-hour", "/menu/happy-hour", "/happy-hour", "/happyhour", "/happyhourpromo", "/hh", "/specials",
]
GENERIC_PATHS = ["/menus", "/menu", "/drinks", "/bar"]

# Which images count as menus.
IMAGE_WORDS = rf"(?i)happy.?hour|happyhour|specials?|menu|drinks?|cocktails?|beer|wine|food|hh{WORD_END}"
IMAGE_FILE = r"(?i)\.(?:png|jpe?g|webp|gif|avif)(?:[?#]|\z)"
IMAGE_SKIP = r"(?i)logo|icon|favicon|avatar|spinner|placeholder|transparent|tracking|pixel"
IMAGE_HOSTS = [".squarespace-cdn.com", ".wixstatic.com", ".webflow.com", ".cloudinary.com", ".imgix.net"]
TINY_PIXELS = 120


def with_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Adds page key, text and the script-shell tests."""
    html = F.col("html")
    return pages.withColumns({"page_key": url_key(F.col("url")), "text": page_text(html, max_chars)}).withColumns({
        "script_shell": is_script_shell(html), "needs_render": needs_render(html, F.col("text")),
    })


def page_links(
    pages: DataFrame, keys: list[str], text_words: str = LINK_TEXT_WORDS, path_words: str = LINK_PATH_WORDS,
    limit: int | None = None,
) -> DataFrame:
    """``keys, ord, url``: the matching links of every page, or the first ``limit``. Shuffles nothing."""
    links = same_site_links(F.col("html"), F.col("url"), text_words, path_words, limit)
    return pages.select(*keys, F.posexplode(links).alias("ord", "url"))


def _is_tiny(url: Column, descriptor: Column) -> Column:
    def small(text: Column, pattern: str, group: int) -> Column:
        digits = F.regexp_extract(text, pattern, group)
        return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint") <= TINY_PIXELS, F.lit(False))

    boxed = r"/w_([0-9]+),h_([0-9]+)"
    asked = r"[?&](?:width|w)=([0-9]+)|[?&]format=([0-9]+)w"
    return (
        small(descriptor, r"(?:^|[^0-9])([0-9]+)w\z", 1)
        | (small(url, boxed, 1) & small(url, boxed, 2))
        | small(url, asked, 1)
        | small(url, asked, 2)
    )


def page_images(pages: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """``keys, ord, url``: images that may show a menu.

    Listing references happens in Python, only for pages that have any;
    choosing is done here. The first reference of an address (without query)
    decides about it, even when its context rules it out. ``limit`` keeps the first
    so many of a page.
    """
    words = IMAGE_WORDS
    base_site = site(host(F.col("url")))
    refs = (
        pages.filter(F.col("html").rlike(image_functions.MAY_HAVE_IMAGES))
        .select(*keys, "url", F.posexplode(image_functions.image_references(F.col("html"))).alias("ord", "ref"))
        .select(*keys, "url", "ord", "ref.raw", "ref.descriptor", "ref.context")
        .filter(~F.startswith("raw", F.lit("data:")))
        .filter(F.col("raw").rlike(IMAGE_FILE) & ~F.col("raw").rlike(IMAGE_SKIP))
        .filter(~_is_tiny(F.col("raw"), F.col("descriptor")))
        .withColumn("to", link_parts(F.col("url"), F.col("raw")))
        .withColumn("key", F.concat("to.scheme", F.lit("://"), "to.host", "to.path"))
        .withColumn("address", F.concat("key", F.regexp_extract("raw", r"(?s)[?#].*\z", 0)))
    )
    image_site = site(F.col("to.host"))
    known_host = image_site == base_site
    for suffix in IMAGE_HOSTS:
        known_host = known_host | F.endswith(image_site, F.lit(suffix))
    telling = F.col("address").rlike(words) | F.col("context").rlike(words)
    allowed = refs.filter((F.col("to.host") == "") | known_host | telling)
    first = first_per_key(allowed, [*keys, "key"], ["ord"])
    targeted = path(F.col("url")).rlike(LINK_PATH_WORDS)
    kept = first.filter(targeted | F.concat("context", F.lit(" "), "address").rlike(words))
    ranked = kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    if limit is not None:
        ranked = ranked.filter(F.col("place") <= limit)
    return ranked.select(*keys, (F.col("place") - 1).alias("ord"), F.col("address").alias("url"))


def choose_site_page(
    sites: DataFrame, pages: DataFrame, explicit: list[str] = EXPLICIT_PATHS, generic: list[str] = GENERIC_PATHS,
    text_words: str = LINK_TEXT_WORDS, path_words: str = LINK_PATH_WORDS,
) -> DataFrame:
    """``base, page_url, tier`` for a table of distinct cleaned site addresses.

    The first page that exists among telling paths, links found on the home
    page, general paths; otherwise the site itself. Candidates are rows, the
    existence test is a semi join on the cleaned address, and the choice is a
    minimum that combines before the shuffle. Links are taken in the scan, of
    pages whose address may be a site's; no page is moved for them.
    """
    tried = F.array(*[
        F.struct(F.lit(tier).alias("tier"), F.lit(i).alias("ord"), F.concat("base", F.lit(p)).alias("candidate"))
        for tier, paths in ((0, explicit), (2, generic)) for i, p in enumerate(paths)
    ])
    fixed = sites.select("base", F.explode(tried).alias("c")).select("base", "c.*")
    addressed = pages.withColumn("address", strip_query(F.col("url")))
    links = same_site_links(F.col("html"), F.col("address"), text_words, path_words)
    linked = likely_rows(addressed, "address", key_bitmap(sites, "base")).select("address", "url", links.alias("links"))
    homes = linked.groupBy("address").agg(F.min(F.struct("url", "links"))["links"].alias("links"))
    homes = homes.join(sites.select(F.col("base").alias("address")), "address", "left_semi")
    crawled = homes.select(
        F.col("address").alias("base"), F.lit(1).alias("tier"), F.posexplode("links").alias("ord", "candidate")
    )
    live = fixed.unionByName(crawled).join(
        addressed.select(F.col("address").alias("candidate")).distinct(), "candidate", "left_semi"
    )
    chosen = live.groupBy("base").agg(F.min(F.struct("tier", "ord", "candidate")).alias("best"))
    return sites.join(chosen, "base", "left").select(
        "base", F.coalesce("best.candidate", "base").alias("page_url"), F.coalesce("best.tier", F.lit(3)).alias("tier")
    )


def site_addresses(places: DataFrame, website: str = "website_url") -> DataFrame:
    """Distinct cleaned websites; places that share one count once from here on."""
    return places.filter(F.col(website) != "").select(strip_query(F.col(website)).alias("base")).distinct()


def choose_page(places: DataFrame, pages: DataFrame, keys: list[str], website: str = "website_url", **options) -> DataFrame:
    """``keys, page_url, tier``: the page to read for every place with a website."""
    chosen = choose_site_page(site_addresses(places, website), pages, **options)
    visited = places.filter(F.col(website) != "").select(*keys, strip_query(F.col(website)).alias("__site"))
    found = lookup(visited, chosen, F.col("__site"), "base", "__page", keys, ["page_url", "tier"])
    return found.select(*keys, "__page.page_url", "__page.tier")


def texts_by_address(pages: DataFrame) -> DataFrame:
    """One text per cleaned address, the longest where several pages share it."""
    return pages.groupBy(strip_query(F.col("url")).alias("address")).agg(
        F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("stored_text")
    )


def better_text(
    base: Column, page_url: Column, text: Column, home_text: Column, root_text: Column, usable: int = SHORT_TEXT
) -> Column:
    """``struct<page_url, text>``: the text, or what the home page says when it is short.

    ``/home`` comes before ``/``; a variant replaces the text only when it is
    strictly longer, and one that is usable ends the search.
    """
    def bare(url: Column) -> Column:
        return F.regexp_replace(url, r"/+\z", "")

    def step(now: Column, path_: str, found: Column) -> Column:
        url = F.concat(base, F.lit(path_))
        size = F.coalesce(F.length(now["text"]), F.lit(0))
        better = (size < usable) & (bare(url) != bare(now["page_url"])) & (F.length(found) > size)
        return F.when(better, F.struct(url.alias("page_url"), found.alias("text"))).otherwise(now)

    start = F.struct(page_url.alias("page_url"), text.alias("text"))
    at_home = let(start, lambda now: step(now, "/home", home_text))
    return let(at_home, lambda now: step(now, "/", root_text))


def fallback_pages(
    chosen: DataFrame, texts: DataFrame, keys: list[str], website: str = "website_url", page_url: str = "page_url",
    text: str = "text", usable: int = SHORT_TEXT,
) -> DataFrame:
    """``better_text`` for rows with a chosen page; ``texts`` comes from ``texts_by_address``.

    Only rows with a short text look anything up.
    """
    base = strip_query(F.col(website))
    short = F.coalesce(F.length(text), F.lit(0)) < usable
    rows = chosen
    for name, path_ in (("__home", "/home"), ("__root", "")):
        address = F.when(short, F.concat(base, F.lit(path_)))
        rows = lookup(rows, texts, address, "address", name, keys, ["stored_text"])
    best = better_text(
        base, F.col(page_url), F.col(text), F.col("__home.stored_text"), F.col("__root.stored_text"), usable
    )
    rest = [c for c in chosen.columns if c not in (page_url, text)]
    return rows.withColumn("__best", best).select(
        *rest, F.col("__best.page_url").alias(page_url), F.col("__best.text").alias(text)
    )


def site_texts(chosen: DataFrame, pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``base, page_url, first_url, text`` of the sites that have a text to read.

    ``chosen`` has ``base`` and ``page_url``. The page and both home variants
    are asked for in one join, and the texts of a site, three at most, are brought
    together by an aggregate. Pages are cleaned in the scan, those that may be
    asked for; what moves is their text.
    """
    asked = F.array(*[
        F.struct(F.lit(i).alias("rank"), address.alias("address"))
        for i, address in enumerate((strip_query(F.col("page_url")), F.concat("base", F.lit("/home")), F.col("base")))
    ])
    wanted = chosen.select("base", "page_url", F.explode(asked).alias("a")).select("base", "page_url", "a.*")
    stored = pages.select(strip_query(F.col("url")).alias("address"), "html")
    likely = likely_rows(stored, "address", key_bitmap(wanted, "address"))
    read = likely.select("address", page_text(F.col("html"), max_chars).alias("text")).join(wanted, "address")
    sized = F.struct(F.length("text").alias("n"), "text")
    texts = read.groupBy("base", "page_url").agg(
        *[F.max(F.when(F.col("rank") == i, sized)).alias(f"t{i}") for i in range(3)]
    )
    best = better_text(F.col("base"), F.col("page_url"), F.col("t0.text"), F.col("t1.text"), F.col("t2.text"))
    return texts.withColumn("best", best).select(
        "base", "best.page_url", F.col("page_url").alias("first_url"), "best.text"
    )


def site_images(chosen: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """``base, page_url, images`` of the sites whose chosen page shows images that may be a menu, in page order.

    ``chosen`` has ``base`` and ``page_url``. Pages that cannot be a chosen one are
    dropped in the scan, and what moves are image addresses. Where several pages
    share an address, the first by URL that has images counts.
    """
    wanted = chosen.select("base", "page_url", strip_query(F.col("page_url")).alias("__at"))
    stored = pages.select(strip_query(F.col("url")).alias("__at"), "url", "html").withColumn("__page", F.col("url"))
    listed = page_images(likely_rows(stored, "__at", key_bitmap(wanted, "__at")), ["__at", "__page"], limit)
    shown = listed.groupBy("__at", "__page").agg(F.sort_array(F.collect_list(F.struct("ord", "url")))["url"].alias("images"))
    first = shown.groupBy("__at").agg(F.min(F.struct("__page", "images"))["images"].alias("images"))
    return wanted.join(first, "__at").select("base", "page_url", "images")
