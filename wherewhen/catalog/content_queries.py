"""Queries about menu items, web pages, long texts and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import focus, markup, urls
from ..operators import documents, items, pages
from ..operators.intervals import merge_intervals
from ..plans import extraction, refresh
from ..operators.keyed import attach_menu
from ..sources import tables
from ..sources.documents import page_by_url, read_place_documents
from ..sources.menu_files import menu_lines, parse_menu_lines
from ..functions.text import not_blank
from ..schema import MORE_KEYWORDS
from ..session import shared_path
from . import area_queries, derived, directory_queries

ANCHORS = [r"(?i)thing", "thble"]
LINK_TEXT, LINK_PATH = "that", r"^/[Tt]h"
BEFORE, AFTER = 40, 300


# --- items ----------------------------------------------------------------------

def cheapest_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.cheapest_per_group(derived.menu_items(spark, sf_dir), ["place_k"])


def _options(word: str, shift: int):
    k = F.col("k")
    return F.transform(
        F.sequence(F.lit(1), (k % (3 + shift)).cast("int") + 1),
        lambda i: F.when((k + i) % 6 == 0, F.lit(word)).otherwise(
            F.concat(F.lit("$"), ((k * i + shift) % 9).cast("string"), F.lit(f".5 {word} "), i.cast("string"))
        ),
    )


def option_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.places(spark, sf_dir).select(
        "k", items.option_summary(_options("dish", 0), _options("drink", 1)).alias("summary")
    )


def price_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollar amounts per document and the first number behind a dollar sign."""
    return derived.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(focus.prices(F.col("text")), ";").alias("prices"),
        focus.first_price(F.col("text")).alias("first_price"),
    )


def _answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return derived.places(spark, sf_dir).select(
        k, "place_id", "restaurant_name",
        F.when(k % 4 != 0, F.struct(
            F.concat(F.lit("Lager "), (k % 3).cast("string")).alias("name"),
            ((k % 9) / 2 + 1).alias("price"),
        )).alias("drink"),
        F.when(k % 3 != 0, F.struct(
            F.lit("Wings").alias("name"), F.when(k % 7 != 0, (k % 5).cast("double")).alias("price")
        )).alias("food"),
    )


def menu_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items.menu_rows(_answer_rows(spark, sf_dir))
    return rows.select(
        "k", "cheapest_drink", "cheapest_drink_price", "cheapest_food", "cheapest_food_price",
        F.concat_ws(";", "all_drink_options", "all_food_options").alias("options"),
    )


def menu_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both line layouts, written from parts and read back."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit('"Bar, '), k.cast("string"), F.lit('"'))).otherwise(
        F.concat(F.lit(" Bar "), k.cast("string"), F.lit(" "))
    )
    rest = F.concat(
        name, F.lit(",Lager,"), F.when(k % 4 == 0, "").otherwise((k % 9).cast("string")),
        F.lit(",Wings,"), F.when(k % 5 == 0, "x").otherwise(F.concat((k % 7).cast("string"), F.lit(".25"))),
        F.lit(",sum"),
    )
    lines = derived.table(spark, sf_dir, "part").select(
        F.when(k % 2 == 0, F.concat(F.lit("ChIJ"), k.cast("string"), F.lit(","), rest)).otherwise(rest).alias("value")
    )
    return parse_menu_lines(lines)


def menu_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items.menu_rows(_answer_rows(spark, sf_dir))
    return menu_lines(rows)


def menu_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the menu file: places with a summary after the menu was attached."""
    joined = attach_menu(derived.places(spark, sf_dir), derived.menu(spark, sf_dir), seeds=["k"])
    return tables.menu_export(joined)


# --- intervals --------------------------------------------------------------------

def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy stretches per user: every event keeps a user busy for a while."""
    begin = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = derived.table(spark, sf_dir, "events").select(
        "user_id", begin.alias("s"), (begin + F.col("event_id") % 50 * 1200).alias("e")
    )
    return merge_intervals(rows, ["user_id"], "s", "e")


def interval_merge_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in microseconds, with a third of all events one user's."""
    begin, k = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")
    rows = derived.table(spark, sf_dir, "events").select(
        F.when(k % 3 == 0, -1).otherwise(F.col("user_id")).alias("user_id"), begin.alias("s"), (begin + k % 50 * 70_000_001).alias("e")
    )
    return merge_intervals(rows, ["user_id"], "s", "e")


# --- pages ------------------------------------------------------------------------

def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "pages")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_text(_pages(spark, sf_dir)).select("page_id", "page_key", "text")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(_pages(spark, sf_dir), ["page_id"], LINK_TEXT, LINK_PATH)


# Link variants put behind every page, and the path each leads to ("-": none).
LINK_VARIANTS = [
    ("specials?x=1#a", "/one/specials"), ("../hh/", "/hh"), ("https://www.HOST/Happy-Hour/", "www"),
    ("https://elsewhere.example/specials", "-"), ("//HOST/a/./b/../specials//x", "/a/./b/../specials//x"),
    ("mailto:specials@x.example", "-"), ("/drink-menu", "-"), ("./x/../../specials", "/specials"),
]


def _page_host():
    return urls.host(F.col("url"))


def _mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant = F.replace(
        derived.pick([v for v, _ in LINK_VARIANTS], F.col("page_id")), F.lit("HOST"), _page_host()
    )
    link = F.concat(F.lit('<p><a class="x" href="'), variant, F.lit('">more</a></p>'))
    # A folder in the address, so that relative targets have somewhere to go.
    address = F.concat(urls.scheme(F.col("url")), F.lit("://"), _page_host(), F.lit("/one/two"))
    return _pages(spark, sf_dir).select("page_id", address.alias("url"), F.concat("html", link, link).alias("html"))


def page_links_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(
        _mixed_pages(spark, sf_dir), ["page_id"], text_words="(?i)no such text", path_words=markup.LINK_PATH_WORDS
    )


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id", urls.strip_query(url).alias("bare"), urls.with_path(url, "/menu").alias("menu"),
        F.array_join(urls.home_variants(url), " ").alias("homes"),
        urls.with_scheme(F.concat(urls.host(url), urls.path(url))).alias("with_scheme"),
        urls.url_key(url).alias("key"),
    )


def spa_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script shells and pages that need rendering; every ninth page carries a builder mark."""
    k = F.col("page_id")
    marked = _pages(spark, sf_dir).withColumn(
        "html",
        F.when(k % 9 == 0, F.concat(F.lit('<meta name="generator" content="Squarespace">'), F.col("html")))
        .when(k % 9 == 1, F.lit("<p>Loading</p>")).otherwise(F.col("html")),
    )
    return pages.with_text(marked).select("page_id", "script_shell", "needs_render")


def rendered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static text against a rendered one; the longer counts."""
    k = F.col("page_id")
    both = _pages(spark, sf_dir).withColumn("static", markup.page_text(F.col("html"), None)).withColumn(
        "rendered",
        F.when(k % 3 == 0, F.concat("static", F.lit("!"))).when(k % 3 == 1, F.col("static").substr(1, 10)),
    )
    return both.select("page_id", F.md5(markup.longer_text(F.col("static"), F.col("rendered"))).alias("text_md5"))


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as found, plus a home page, a menu or a specials page for some of them."""
    p = _pages(spark, sf_dir)
    k, root = F.col("page_id"), F.concat(urls.scheme(F.col("url")), F.lit("://"), _page_host(), F.lit("/s"), F.col("page_id").cast("string"))
    extra = F.filter(
        F.array(
            F.when(k % 3 == 0, F.concat(root, F.lit("/"))), F.when(k % 4 == 0, F.concat(root, F.lit("/menu"))),
            F.when(k % 7 == 0, F.concat(root, F.lit("/specials?a=1"))), F.when(k % 5 == 0, F.concat(root, F.lit("/home"))),
        ),
        lambda x: x.isNotNull(),
    )
    link = F.concat(F.lit('<a href="/s'), k.cast("string"), F.lit('/happyhourpage">go</a>'))
    made = p.select("page_id", F.explode(extra).alias("url"), F.concat("html", link).alias("html"))
    linked = p.filter(k % 6 == 0).select("page_id", F.concat(root, F.lit("/happyhourpage/")).alias("url"), "html")
    return p.unionByName(made).unionByName(linked)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    root = F.concat(urls.scheme(F.col("url")), F.lit("://"), _page_host(), F.lit("/s"), k.cast("string"))
    return _pages(spark, sf_dir).select(
        k, F.when(k % 10 == 9, "").otherwise(F.concat(root, F.lit("/?utm=1"))).alias("website_url")
    )


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.choose_page(_sites(spark, sf_dir), _site_pages(spark, sf_dir), ["page_id"]).select(
        "page_id", "page_url", "tier"
    )


def page_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short chosen texts replaced by what the home page says."""
    k = F.col("page_id")
    chosen = _sites(spark, sf_dir).filter(F.col("website_url") != "").select(
        "page_id", "website_url", F.concat(urls.strip_query(F.col("website_url")), F.lit("/menu")).alias("page_url"),
        F.repeat(F.lit("x"), (k % 5 * 90).cast("int")).alias("text"),
    )
    known = _site_pages(spark, sf_dir).withColumn(
        "text", F.repeat(F.lit("y"), (k * 37 % 500).cast("int"))
    ).select("url", "text")
    out = pages.fallback_pages(chosen, pages.texts_by_address(known), ["page_id"])
    return out.select("page_id", "page_url", F.length("text").alias("n_chars"), F.col("text").substr(1, 1).alias("kind"))


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages by the key of the address; every fourth address is unknown."""
    p = _pages(spark, sf_dir)
    asked = p.select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url")).alias("url"))
    return page_by_url(p, asked).select("page_id", "page_key", F.md5("html").alias("html_md5"))


def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images put into every page in several notations."""
    k = F.col("page_id").cast("string")
    block = F.concat(
        F.lit('<div><img class="l" src="/logo.png"><img src="/img/'), k,
        F.lit('.jpg?w=900" srcset="/img/small.jpg 80w, /img/large-'), k,
        F.lit('.webp 1200w"><i style="background:url(\'bg'), k,
        F.lit('.png\')">Drinks menu</i><img data-src="https://x.example/a.png"><img src="data:image/png;base64,AA"></div>'),
    )
    return pages.page_images(
        _pages(spark, sf_dir).select("page_id", "url", F.concat("html", block).alias("html")), ["page_id"]
    )


# --- long texts -------------------------------------------------------------------

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "documents")


def focus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged windows around two anchors in every document."""
    windows = focus.focus_windows(F.col("text"), ANCHORS, BEFORE, AFTER)
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(windows).alias("ord", "w")).select(
        "doc_id", "ord", F.col("w.s").alias("s"), F.col("w.e").alias("e")
    )


def focused_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = focus.focused_text(F.col("text"), ANCHORS, BEFORE, AFTER)
    return _documents(spark, sf_dir).select("doc_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against an item name: the first two words of the next document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    names = docs.select(
        (F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit("$5 "), F.substring_index("text", " ", 2)).alias("name")
    )
    return docs.join(names, "doc_id").select(
        "doc_id", "name", focus.is_grounded(F.col("name"), F.col("text")).alias("grounded")
    )


# --- place documents and answers ---------------------------------------------------

def place_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents made from the places."""
    k = F.col("k")
    types = [
        "cafe,coffee_shop", "bar,restaurant", "", "CAFE,BAKERY", "cafe,coffee_shop,food,point_of_interest",
        "juice_bar,food", "fast_food_restaurant,bar,food", "museum,zoo", "BAR,CAFE",
    ]
    lines = F.filter(F.split("happy_hour_times", r" \| "), lambda x: x != "")
    entry = lambda kind, text: F.struct(F.lit(kind).alias("secondaryHoursType"), text.alias("weekdayDescriptions"))
    none = F.array().cast("array<string>")
    hours = F.when(k % 6 == 0, F.array(entry("DELIVERY", lines), entry("happy_hour", none), entry("HAPPY_HOUR", lines))).when(
        k % 6 == 1, F.array(entry("HAPPY_HOUR", none))
    ).when(k % 6 == 2, F.array(entry("DRIVE_THROUGH", lines)))
    picked = derived.pick(types, k)
    return derived.places(spark, sf_dir).select(
        k,
        F.when(F.col("place_id") != "", F.col("place_id")).alias("id"),
        F.struct(F.col("restaurant_name").alias("text"), F.lit("en").alias("languageCode")).alias("displayName"),
        F.col("address").alias("formattedAddress"),
        F.when(k % 9 != 2, F.filter(F.split(picked, ","), lambda x: x != "")).alias("types"),
        F.when(F.col("phone_number") != "", F.col("phone_number")).alias("nationalPhoneNumber"),
        F.when(F.col("website_url") != "", F.col("website_url")).alias("websiteUri"),
        F.when(F.col("regular_hours") != "", F.struct(F.split("regular_hours", r" \| ").alias("weekdayDescriptions"))).alias("regularOpeningHours"),
        hours.alias("currentSecondaryOpeningHours"),
        F.when(k % 10 == 0, "0").otherwise(F.col("rating")).alias("rating"),
        F.when(k % 8 != 0, (k % 50).cast("string")).alias("userRatingCount"),
        F.when(F.col("price_level") != "", F.col("price_level")).alias("priceLevel"),
        F.when(F.col("lat").isNotNull(), F.struct(F.col("latitude"), F.col("longitude"))).alias("location"),
        F.lit(None).cast("string").alias("googleMapsUri"),
    )


def place_documents_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = documents.flatten_places(place_documents(spark, sf_dir).filter(F.col("id").isNotNull()))
    return flat.select(
        "place_id", "restaurant_name", "address", "phone_number", "website_url", "happy_hour_times", "regular_hours",
        "rating", "review_count", "price_level", "source", "latitude", "longitude", "generative_summary",
    )


def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.exclude_categories(place_documents(spark, sf_dir)).select("k")


def documents_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.documents_within(place_documents(spark, sf_dir), (32.762889, -117.119922), 4000).select("k")


def gap_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-filling searches of every density cell: one row per cell and keyword."""
    from ..operators import quadtree
    from ..schema import DEFAULT_AREA

    cells = quadtree.quadtree_cells(derived.places(spark, sf_dir), DEFAULT_AREA, key="place_id", order=["k"])
    return cells.select("path", F.posexplode(documents.gap_keywords()).alias("ord", "keyword"))


def _menu_answer():
    k = F.col("k")
    body = F.concat(
        F.lit('{"drink": {"name": "$'), (k % 9).cast("string"), F.lit(" Street "), (k % 4).cast("string"),
        F.lit('", "price": '), (k % 9).cast("string"), F.lit(".5}, \"food\": "),
        F.when(k % 3 == 0, "null").otherwise('{"name": "unicorn", "price": 4}'), F.lit(', "short_summary": "s'),
        (k % 5).cast("string"), F.lit('"}'),
    )
    return (
        F.when(k % 7 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone")))
        .when(k % 7 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(k % 7 == 2, F.concat(F.lit("I think "), body, F.lit(" fits")))
        .when(k % 7 == 3, F.lit("no menu found"))
        .when(k % 7 == 4, F.concat(body, F.lit("}")))
        .otherwise(body)
    )


def _hours_answer():
    k = F.col("k")
    body = F.concat(
        F.lit('{"happy_hours": '),
        F.when(k % 5 == 0, "[]").otherwise('[{"day": "Monday", "times": "3 - 6 PM"}, {"day": "", "times": "x"}, {"day": "Friday", "times": "4 - 7 PM"}]'),
        F.when(k % 4 == 0, "").otherwise(F.concat(
            F.lit(', "confidence": "'), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("none")), (k % 4).cast("int") + 1), F.lit('"')
        )),
        F.lit("}"),
    )
    return F.when(k % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)


def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.jsontext import parse_hours, parse_menu

    rows = derived.places(spark, sf_dir).select("k", parse_menu(_menu_answer()).alias("m"), parse_hours(_hours_answer()).alias("h"))
    return rows.select(
        "k", F.col("m.drink.name").alias("drink"), F.col("m.drink.price").alias("drink_price"),
        F.col("m.food.name").alias("food"), F.col("m.short_summary").alias("summary"),
        F.size("h.happy_hours").alias("n_hours"), F.col("h.confidence").alias("confidence"),
    )


def hours_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = derived.places(spark, sf_dir)
    answers = places.select("k", _hours_answer().alias("response"))
    return extraction.apply_hours_responses(places, answers, ["k"]).select(
        "k", "happy_hour_times", "source", "extracted"
    )


def menus_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu answers checked against the text of the place, here its address."""
    none = F.lit(None).cast("string")
    places = derived.places(spark, sf_dir).withColumns({
        "cheapest_drink": none, "cheapest_food": none, "menu_url": none,
        "cheapest_drink_price": F.lit(None).cast("double"), "cheapest_food_price": F.lit(None).cast("double"),
    })
    prompts = places.select("k", F.col("address").alias("text"), F.col("website_url").alias("page_url"), F.col("website_url").alias("first_url"))
    answers = places.select("k", _menu_answer().alias("response"))
    return extraction.apply_menu_responses(places, prompts, answers, ["k"]).select(
        "k", "cheapest_drink", "cheapest_drink_price", "cheapest_food", "cheapest_food_price", "menu_summary",
        "menu_url", "extracted",
    )


def _two_sided(spark: SparkSession, sf_dir: str, text, image):
    """Places and repeated answers: from text for two thirds of them, from images for two thirds."""
    places, third = derived.places(spark, sf_dir), F.col("k") % 3
    twice = F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")
    answers = places.where(third != 0).select("k", twice).select("k", "ord", text.alias("response"))
    seen = places.where(third != 1).select("k", twice).select("k", "ord", image.alias("response"))
    return places, answers, seen


def image_menus_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu answers of places that have one from text, from images or both, each twice."""
    k = F.col("k")
    text = F.when(F.col("ord") == 0, '{"drink": {"name": "", "price": 77}, "short_summary": "old"}').when(
        k % 3 == 1, F.format_string('{"drink": {"name": "", "price": %d}, "short_summary": "t"}', k % 9)
    ).otherwise('{"drink": {"name": "unicorn", "price": 5}, "short_summary": "t"}')
    image = F.when(F.col("ord") == 0, '{"drink": {"name": "Old", "price": 77}}').otherwise(
        F.format_string('{"food": {"name": "Seen", "price": %d}, "short_summary": "i"}', k % 5)
    )
    places, answers, seen = _two_sided(spark, sf_dir, text, image)
    none, site = F.lit(None).cast("string"), F.col("website_url")
    places = places.withColumns({
        "cheapest_drink": none, "cheapest_food": none, "menu_url": none,
        "cheapest_drink_price": F.lit(None).cast("double"), "cheapest_food_price": F.lit(None).cast("double"),
    })
    prompts = places.where(k % 3 != 0).select(
        "k", F.col("address").alias("text"), site.alias("page_url"), F.concat(site, F.lit("/first")).alias("first_url")
    )
    return extraction.apply_menu_responses(places, prompts, answers, ["k"], seen, order="ord").select(
        "k", "cheapest_drink", "cheapest_drink_price", "cheapest_food", "cheapest_food_price", "menu_summary",
        "menu_url", "extracted",
    )


def image_hours_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of places that have an answer from text, from images or both, each twice."""
    good = '{"happy_hours": [{"day": "Monday", "times": "3 PM - 5 PM"}], "confidence": "%s"}'
    text = F.when((F.col("ord") == 0) | (F.col("k") % 3 == 1), good % "high").otherwise(good % "low")
    image = F.when(F.col("ord") == 0, good % "none").otherwise(good % "medium")
    places, answers, seen = _two_sided(spark, sf_dir, text, image)
    return extraction.apply_hours_responses(places, answers, ["k"], seen, order="ord").select(
        "k", "happy_hour_times", "source", "extracted"
    )


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of every place, its address standing for the page text."""
    return derived.places(spark, sf_dir).select(
        "k",
        extraction.menu_prompt(F.col("restaurant_name"), F.col("address"), F.col("happy_hour_times")).alias("menu_prompt"),
        extraction.hours_prompt(F.col("address")).alias("hours_prompt"),
    )


def menu_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages chosen, cleaned, focused and turned into prompts."""
    sites = _sites(spark, sf_dir).join(
        derived.places(spark, sf_dir).select(F.col("k").alias("page_id"), "restaurant_name", "happy_hour_times"), "page_id"
    )
    made = extraction.build_menu_prompts(sites, _site_pages(spark, sf_dir), ["page_id"], anchors=ANCHORS)
    return made.select("page_id", "page_url", F.length("text").alias("text_chars"), F.md5("prompt").alias("prompt_md5"))


def hours_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for weekly hours, with the whole text of the chosen page."""
    made = extraction.build_hours_prompts(_sites(spark, sf_dir), _site_pages(spark, sf_dir), ["page_id"])
    return made.select("page_id", "page_url", F.length("text").alias("text_chars"), F.md5("prompt").alias("prompt_md5"))


def _image_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Places, one per page row, and pages of their sites: home pages of text or of images, some with a menu page."""
    p, k = _pages(spark, sf_dir), F.col("page_id")
    root = F.concat(urls.scheme(F.col("url")), F.lit("://"), _page_host(), F.lit("/s"), k.cast("string"))
    images = F.format_string('<img src="/img/%d.jpg"><img src="/menu-%d.png">', k, k)
    home = F.when(k % 3 == 0, images).when(k % 3 == 1, F.concat(F.lit("<p>deals</p>"), "html"))
    menu = F.when(k % 8 == 0, images).when(k % 8 == 4, F.lit("<p>short</p>"))
    made = p.select(F.explode(F.array(
        F.struct(F.concat(root, F.lit("/")).alias("url"), home.alias("html")), F.struct(F.concat(root, F.lit("/specials")).alias("url"), menu.alias("html")),
    )).alias("made")).select("made.*").where("html IS NOT NULL")
    schedule = F.when(k % 2 == 0, F.concat(F.lit(" Friday: 4 - 6 PM, seat "), k.cast("string"))).otherwise("")
    places = p.select(k, F.concat(F.lit("Venue "), k.cast("string")).alias("restaurant_name"), F.concat(root, F.lit("/?utm=1")).alias("website_url"), schedule.alias("happy_hour_times"))
    return places, made


def image_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over images, for places whose website has no text."""
    places, stored = _image_sites(spark, sf_dir)
    made = extraction.build_menu_image_prompts(places, stored, ["page_id"])
    return made.select("page_id", "page_url", F.array_join("images", " ").alias("images"), "prompt")


def hours_image_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over images, for places whose text left no confident answer about hours."""
    places, stored = _image_sites(spark, sf_dir)
    k = F.col("page_id")
    words = F.when(k % 5 == 0, "high").when(k % 5 == 1, "low").otherwise("none")
    answers = places.where(k % 5 < 3).select(k, F.concat(F.lit('{"happy_hours": [], "confidence": "'), words, F.lit('"}')).alias("response"))
    made = extraction.build_hours_image_prompts(places, stored, ["page_id"], answers)
    return made.select("page_id", "page_url", F.array_join("images", " ").alias("images"), "prompt")


def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits and place documents merged into the directory in one job."""
    return _refreshed(spark, sf_dir)


def _refreshed(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    from .directory_queries import NOW

    documents_ = place_documents(spark, sf_dir).drop("k")
    existing = derived.places(spark, sf_dir).filter(F.col("k") % 3 != 0).withColumn("ord", F.col("k")).drop("k", "lat", "lng")
    hits = derived.table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 5).alias("keyword_ord"), F.floor(F.col("l_partkey") / 20).alias("page"),
        (F.col("l_partkey") % 20).alias("pos"), derived.place_key(F.col("l_orderkey")).alias("place_id"),
    )
    merged = refresh.refresh(existing, hits, documents_, NOW, max_results=most)
    return merged.select("place_id", "restaurant_name", "rating", "happy_hour_times", "freshness_date", "action", "upgraded")


MOST_RESULTS = 2000


def full_refresh_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``full_refresh`` with the cap on candidates, the first so many hits."""
    return _refreshed(spark, sf_dir, MOST_RESULTS)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written as CSV and read back, through the shared folder."""
    k = F.col("k")
    path = shared_path(spark, "csv-round-trip")
    price = F.when(k % 7 != 0, k % 9 / 2)
    tables.write_table(derived.places(spark, sf_dir).withColumn("cheapest_drink_price", price), path, [
        "restaurant_name", "place_id", "happy_hour_times", "review_count", "cheapest_drink_price", "menu_summary",
    ])
    back = tables.read_places(spark, path)
    shown = F.when(not_blank(F.col("happy_hour_times")), F.col("happy_hour_times"))
    return back.select(
        "place_id", "restaurant_name", shown.alias("happy_hour_times"), "review_count", "cheapest_drink_price", "google_maps_url", "menu_url",
    )


def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place documents written as JSON lines, with fields nobody asked for, read back by the field mask and flattened."""
    path = shared_path(spark, "document-round-trip")
    place_documents(spark, sf_dir).filter(F.col("id").isNotNull()).withColumn("extra", F.struct(F.lit(1).alias("x"))).write.json(path)
    flat = documents.flatten_places(read_place_documents(spark, path))
    return flat.select(
        "place_id", "restaurant_name", "address", "phone_number", "website_url", "happy_hour_times", "regular_hours",
        "rating", "review_count", "price_level", "source", "latitude", "longitude", "generative_summary",
    )


def enriched_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page build: overrides, neighborhood and menu on every place."""
    places = derived.places(spark, sf_dir).withColumnRenamed("k", "ord").drop("lat", "lng")
    built = refresh.enrich(places, derived.overrides(spark, sf_dir), derived.menu(spark, sf_dir))
    return built.select("ord", "happy_hour_times", "source", "neighborhood", "cheapest_drink", "cheapest_drink_price", "menu_summary")


QUERIES = {
    f.__name__: f
    for f in (
        cheapest_per_category, option_summary, price_tokens, menu_labels, menu_file_rows, menu_file_lines, menu_export,
        interval_merge, interval_merge_micros, page_text, page_links, page_links_mixed, url_forms, spa_pages, rendered_text,
        page_candidates, page_fallback, page_lookup, image_candidates, focus_windows, focused_texts,
        grounding_check, place_documents_flat, category_filter, documents_within, gap_keywords, response_parse,
        hours_applied, menus_applied, image_menus_applied, image_hours_applied, prompt_texts, menu_prompts, hours_prompts, image_prompts, hours_image_prompts, full_refresh,
        full_refresh_capped, csv_round_trip, document_round_trip,
        enriched_site,
    )
}


# --- SQL ----------------------------------------------------------------------------

def _template_sql(template: str, **values: str) -> str:
    text = derived.sql_text(template)
    for name, value in values.items():
        text = text.replace("{" + name + "}", f"' || {value} || '")
    return text


# A menu page is tried before the home page and shows all its images; a home page only those that name a menu.
_IMAGE_SITES_SQL = r"""
WITH sites AS (
  SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS root FROM pages
),
shown AS (
  SELECT page_id, root || '/s' || page_id || '/specials' AS page_url,
    root || '/img/' || page_id || '.jpg ' || root || '/menu-' || page_id || '.png' AS images FROM sites WHERE page_id % 8 = 0
  UNION ALL
  SELECT page_id, root || '/s' || page_id, root || '/menu-' || page_id || '.png' FROM sites WHERE page_id % 4 <> 0 AND page_id % 3 = 0
)"""

_OPTION_SQL = r"""
opt AS (
  SELECT k, 0 AS side, i, CASE WHEN (k + i) % 6 = 0 THEN 'dish' ELSE '$' || ((k * i) % 9) || '.5 dish ' || i END AS t
  FROM places, range(1, 4) r(i) WHERE i <= k % 3 + 1
  UNION ALL
  SELECT k, 1, i, CASE WHEN (k + i) % 6 = 0 THEN 'drink' ELSE '$' || ((k * i + 1) % 9) || '.5 drink ' || i END
  FROM places, range(1, 5) r(i) WHERE i <= k % 4 + 1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY
      coalesce(TRY_CAST(regexp_extract(t, '\$([0-9.]+)', 1) AS DOUBLE), 0), side, i) AS rn,
    count(*) OVER (PARTITION BY k) AS n
  FROM opt
)"""
_ANSWER_SQL = """
ans AS (
  SELECT k, place_id, restaurant_name,
    CASE WHEN k % 4 <> 0 THEN (k % 9) / 2.0 + 1 END AS dp,
    CASE WHEN k % 4 <> 0 THEN 'Lager ' || (k % 3) END AS dn,
    CASE WHEN k % 3 <> 0 AND k % 7 <> 0 THEN CAST(k % 5 AS DOUBLE) END AS fp,
    CASE WHEN k % 3 <> 0 THEN 'Wings' END AS fn
  FROM places
),
lab AS (
  SELECT *, CASE WHEN dn IS NULL THEN '' ELSE '$' || CASE WHEN dp = floor(dp) THEN CAST(CAST(dp AS BIGINT) AS VARCHAR)
      ELSE CAST(CAST(dp AS DOUBLE) AS VARCHAR) END || ' ' || dn END AS dl,
    CASE WHEN fn IS NULL THEN '' ELSE '$' || coalesce(CAST(CAST(fp AS BIGINT) AS VARCHAR), 'null') || ' ' || fn END AS fl
  FROM ans
)"""
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _text_sql(html: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({html}, '(?s)<script[^>]*>.*?</script>', "
        rf"'', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}', ' ', 'g'))"
    )


_SCHEME_SQL = "split_part(url, ':', 1)"
_HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_ROOT_SQL = f"({_SCHEME_SQL} || '://' || {_HOST_SQL} || '/s' || page_id)"
_BARE_SQL = r"rtrim(regexp_replace(url, '[?#].*$', ''), '/')"


def _focus_sql(table: str, key: str, before: int, after: int) -> list[str]:
    """Windows around the anchors of a text table, step by step."""
    offsets = [
        part
        for i, p in enumerate(ANCHORS)
        for part in (
            rf"""
pieces{i} AS (
  SELECT {key}, unnest(p) AS piece, unnest(list_concat(m, [''])) AS hit, generate_subscripts(p, 1) AS i
  FROM (SELECT {key}, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}') AS m FROM {table})
)""",
            rf"""
starts{i} AS (
  SELECT {key}, hit, CAST(sum(length(piece)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY {key} ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM pieces{i} WINDOW w AS (PARTITION BY {key} ORDER BY i)
)""",
        )
    ]
    return [
        *offsets,
        rf"""
anchors AS (
  SELECT d.{key}, d.text, length(d.text) AS n, start FROM (
    SELECT {key}, start, hit FROM starts0 UNION ALL SELECT {key}, start, hit FROM starts1) a
  JOIN {table} d USING ({key}) WHERE hit <> '' AND length(d.text) > 200
)""",
        rf"""
spans AS (
  SELECT {key}, greatest(start - {before}, 0) AS s, least(n, start + {after}) AS e FROM anchors
  WHERE NOT (start < n * 0.1
    AND regexp_matches(substr(text, greatest(start - 120, 0) + 1, start + 120 - greatest(start - 120, 0)),
      '(?:(?:[A-Z][A-Za-z&]+|[A-Z]{{2,}})\s+){{3,}}(?:[A-Z][A-Za-z&]+|[A-Z]{{2,}})')
    AND NOT regexp_matches(substr(text, start + 1, 600), '(?i)\$\s*[0-9]+|[0-9]+\s*(?:bucks?|dollars?)'))
)""",
        rf"""
flags AS (
  SELECT *, s > coalesce(max(e) OVER (PARTITION BY {key} ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM spans
)""",
        rf"""
isles AS (
  SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM flags
)""",
        f"windows AS (SELECT {key}, isle, min(s) AS s, max(e) AS e FROM isles GROUP BY {key}, isle)",
        f"""
cut AS (
  SELECT {key}, string_agg(substr(text, s + 1, e - s), chr(10) || chr(10) ORDER BY s) AS t
  FROM windows JOIN {table} USING ({key}) GROUP BY {key}
)""",
    ]


_FOCUS_SQL = _focus_sql("documents", "doc_id", BEFORE, AFTER)
_MENU_OK = "k % 7 NOT IN (3, 4)"
_FLAT_HOURS = (
    "CASE WHEN k % 6 = 0 THEN array_to_string(list_filter(string_split(happy_hour_times, ' | '), lambda x: x <> ''), "
    "' | ') ELSE '' END"
)



def _menu_prompt_sql(text: str) -> str:
    schedule = (
        "' || CASE WHEN trim(happy_hour_times) <> '' THEN 'Known hours: ' || trim(happy_hour_times) || chr(10) "
        "ELSE '' END || '"
    )
    return (
        derived.sql_text(extraction.MENU_TEMPLATE).replace("{name}", "' || restaurant_name || '")
        .replace("{text}", f"' || {text} || '").replace("{schedule}", schedule)
    )


_CHOSEN_SQL = [
    derived.PLACES_SQL,
    # t0: the page as it is, t1: with the link that made-up pages carry.
    f"""
cleaned AS (
  SELECT page_id, {_ROOT_SQL} AS root, {_text_sql('html')} AS t0,
    {_text_sql("(html || '<a href=\"/s' || page_id || '/happyhourpage\">go</a>')")} AS t1
  FROM pages WHERE page_id % 10 <> 9
)""",
    """
first_page AS (
  SELECT *, CASE WHEN page_id % 7 = 0 THEN root || '/specials' WHEN page_id % 6 = 0 THEN root || '/happyhourpage'
      WHEN page_id % 4 = 0 THEN root || '/menu' ELSE root END AS url0,
    CASE WHEN page_id % 7 = 0 THEN t1 WHEN page_id % 6 = 0 THEN t0 WHEN page_id % 4 = 0 OR page_id % 3 = 0 THEN t1 END
      AS text0
  FROM cleaned
)""",
    """
home AS (
  SELECT *, coalesce(length(text0), 0) < 300 AND page_id % 5 = 0 AND length(t1) > coalesce(length(text0), 0) AS took
  FROM first_page
)""",
    """
second_page AS (
  SELECT *, CASE WHEN took THEN root || '/home' ELSE url0 END AS url1, CASE WHEN took THEN t1 ELSE text0 END AS text1
  FROM home
)""",
    """
chosen AS (
  SELECT page_id, CASE WHEN again THEN root || '/' ELSE url1 END AS page_url, CASE WHEN again THEN t1 ELSE text1 END AS text
  FROM (SELECT *, coalesce(length(text1), 0) < 300 AND page_id % 3 = 0 AND url1 <> root
      AND length(t1) > coalesce(length(text1), 0) AS again FROM second_page)
)""",
]

def _refresh_sql(found: str, *more: str) -> str:
    return derived.with_sql(
        [
            derived.PLACES_SQL,
            "existing AS (SELECT * FROM places WHERE k % 3 <> 0)",
            """
recent AS (
  SELECT place_id FROM existing WHERE place_id <> ''
    AND TRY_CAST(freshness_date AS DATE) >= TIMESTAMP '2024-03-10 12:00:00' - INTERVAL 30 DAY
)""",
            *more,
            f"""
fetched AS (
  SELECT place_id, restaurant_name, CASE WHEN k % 10 = 0 THEN '' ELSE rating END AS rating,
    {_FLAT_HOURS} AS happy_hour_times, '2024-03-10' AS freshness_date
  FROM places
  WHERE place_id <> '' AND {found} AND place_id NOT IN (SELECT place_id FROM recent)
    AND NOT (k % 9 IN (0, 3, 4, 5) AND k % 6 NOT IN (0, 1))
)""",
            """
fresh_rows AS (
  SELECT * FROM fetched UNION ALL
  SELECT place_id, restaurant_name, rating, happy_hour_times, freshness_date FROM existing
  WHERE place_id IN (SELECT place_id FROM recent) AND place_id NOT IN (SELECT place_id FROM fetched)
)""",
            # Names occur twice, so at most one new id meets a name without id.
            """
aimed AS (
  SELECT n.*, CASE WHEN e.place_id IS NOT NULL THEN 'id:' || n.place_id WHEN l.restaurant_name IS NOT NULL
      THEN 'name:' || n.restaurant_name ELSE 'id:' || n.place_id END AS target
  FROM fresh_rows n LEFT JOIN existing e ON e.place_id = n.place_id
  LEFT JOIN existing l ON l.place_id = '' AND l.restaurant_name = n.restaurant_name
)""",
            """
known AS (
  SELECT *, CASE WHEN place_id <> '' THEN 'id:' || place_id ELSE 'name:' || restaurant_name END AS target FROM existing
)""",
        ],
        """SELECT coalesce(n.place_id, e.place_id) AS place_id, coalesce(n.restaurant_name, e.restaurant_name)
             AS restaurant_name, coalesce(n.rating, e.rating) AS rating,
             coalesce(nullif(n.happy_hour_times, ''), e.happy_hour_times, n.happy_hour_times) AS happy_hour_times,
             CASE WHEN n.target IS NOT NULL THEN n.freshness_date ELSE e.freshness_date END AS freshness_date,
             CASE WHEN e.target IS NULL THEN 'added' WHEN n.target IS NOT NULL THEN 'updated' ELSE 'kept' END AS action,
             starts_with(target, 'name:') AND n.target IS NOT NULL AS upgraded
           FROM known e FULL JOIN aimed n USING (target)""",
    )


ORACLE = {
    "cheapest_per_category": derived.with_sql(
        [derived.MENU_ITEMS_SQL],
        """SELECT place_k, d.name AS cheapest_drink, d.price AS cheapest_drink_price, f.name AS cheapest_food,
             f.price AS cheapest_food_price FROM (
             SELECT place_k,
               min(struct_pack(price, line, part, supp, cents, name))
                 FILTER (WHERE category = 'drink' AND price IS NOT NULL) AS d,
               min(struct_pack(price, line, part, supp, cents, name))
                 FILTER (WHERE category = 'food' AND price IS NOT NULL) AS f
             FROM menu_items GROUP BY place_k)""",
    ),
    "option_summary": derived.with_sql(
        [derived.PLACES_SQL, _OPTION_SQL],
        """SELECT k, string_agg(t, ', ' ORDER BY rn) FILTER (WHERE rn < n) || ' and ' || max(t) FILTER (WHERE rn = n)
             AS summary FROM ranked GROUP BY k HAVING max(n) > 1
           UNION ALL SELECT k, t FROM ranked WHERE n = 1""",
    ),
    "price_tokens": r"""
        SELECT doc_id, array_to_string(regexp_extract_all(text, '\$\s*([0-9]+(?:\.[0-9]+)?)', 1), ';') AS prices,
          coalesce(TRY_CAST(nullif(regexp_extract(regexp_extract(text, '\$([0-9.]+)', 1), '^([0-9]+\.?[0-9]*|\.[0-9]+)',
            1), '') AS DOUBLE), 0.0) AS first_price FROM documents""",
    "menu_labels": derived.with_sql(
        [derived.PLACES_SQL, _ANSWER_SQL],
        """SELECT k, dl AS cheapest_drink, CAST(dp AS DOUBLE) AS cheapest_drink_price, fl AS cheapest_food,
             fp AS cheapest_food_price, concat_ws(';', nullif(dl, ''), nullif(fl, '')) AS options FROM lab""",
    ),
    "menu_file_rows": """
        SELECT CASE WHEN p_partkey % 2 = 0 THEN 'ChIJ' || p_partkey ELSE '' END AS place_id,
          CASE WHEN p_partkey % 3 = 0 THEN 'Bar, ' ELSE 'Bar ' END || p_partkey AS restaurant_name,
          'Lager' AS cheapest_drink, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 9 AS DOUBLE) END
            AS cheapest_drink_price,
          'Wings' AS cheapest_food, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 7 + CAST(0.25 AS DOUBLE) END
            AS cheapest_food_price FROM part""",
    "menu_file_lines": derived.with_sql(
        [derived.PLACES_SQL, _ANSWER_SQL],
        """SELECT place_id, restaurant_name, dl AS cheapest_drink,
             coalesce(CASE WHEN dp = floor(dp) THEN CAST(CAST(dp AS BIGINT) AS VARCHAR)
               ELSE CAST(CAST(dp AS DOUBLE) AS VARCHAR) END, '') AS cheapest_drink_price,
             fl AS cheapest_food, coalesce(CAST(CAST(fp AS BIGINT) AS VARCHAR), '') AS cheapest_food_price,
             CASE WHEN dl = '' THEN fl WHEN fl = '' THEN dl WHEN coalesce(fp, 0) <= dp THEN fl || ' and ' || dl
               ELSE dl || ' and ' || fl END AS cheapest_options_summary FROM lab""",
    ),
    "menu_export": directory_queries.ORACLE["menu_join"].replace("SELECT p.k, nullif", """SELECT place_id, restaurant_name,
             coalesce(cheapest_drink, '') AS cheapest_drink,
             coalesce(CAST(cheapest_drink_price AS VARCHAR), '') AS cheapest_drink_price,
             coalesce(cheapest_food, '') AS cheapest_food,
             coalesce(CAST(cheapest_food_price AS VARCHAR), '') AS cheapest_food_price, menu_summary,
             coalesce(menu_url, '') AS menu_url FROM (SELECT p.place_id, p.restaurant_name, nullif""", 1)
    + ") WHERE menu_summary <> ''",
    "interval_merge": """
        WITH r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s,
            CAST(floor(epoch(ts)) AS BIGINT) + event_id % 50 * 1200 AS e FROM events),
        f AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM r),
        g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle
            FROM f)
        SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, isle""",
    "interval_merge_micros": """
        WITH r AS (SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, CAST(epoch_us(ts) AS BIGINT) AS s,
            CAST(epoch_us(ts) AS BIGINT) + event_id % 50 * 70000001 AS e FROM events),
        f AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM r),
        g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle
            FROM f)
        SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, isle""",
    "page_text": f"SELECT page_id, left(md5(url), 16) AS page_key, {_text_sql('html')} AS text FROM pages",
    "page_links": rf"""
        WITH tags AS (
          SELECT page_id, url AS page, unnest(t) AS tag, generate_subscripts(t, 1) AS i FROM (
            SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS t FROM pages)),
        links AS (
          SELECT page_id, i, regexp_extract(page, '^[a-z]+://[^/?#]*')
              || rtrim(regexp_extract(tag, 'href="([^"?#]*)', 1), '/') AS url,
            regexp_extract(tag, 'href="([^"?#]*)', 1) AS path, regexp_replace(tag, '<[^>]+>', ' ', 'g') AS txt FROM tags),
        firsts AS (
          SELECT page_id, url, min(i) AS i FROM links
          WHERE regexp_matches(path, '{LINK_PATH}') OR regexp_matches(txt, '{LINK_TEXT}') GROUP BY page_id, url)
        SELECT page_id, CAST(rn - 1 AS INT) AS ord, url FROM (
          SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM firsts)""",
    "page_links_mixed": (
        f"SELECT page_id, CAST(0 AS INT) AS ord, CASE page_id % {len(LINK_VARIANTS)} " + " ".join(
            f"WHEN {i} THEN " + (
                f"'https://www.' || {_HOST_SQL} || '/Happy-Hour'" if to == "www"
                else f"{_SCHEME_SQL} || '://' || {_HOST_SQL} || '{to}'"
            ) for i, (_, to) in enumerate(LINK_VARIANTS) if to != "-"
        ) + f" END AS url FROM pages WHERE page_id % {len(LINK_VARIANTS)} IN ("
        + ", ".join(str(i) for i, (_, to) in enumerate(LINK_VARIANTS) if to != "-") + ")"
        # Only one leading www. is taken off before hosts are compared.
        + f" AND NOT (page_id % {len(LINK_VARIANTS)} = 2 AND starts_with({_HOST_SQL}, 'www.'))"
    ),
    "url_forms": rf"""
        SELECT page_id, {_BARE_SQL} AS bare, {_BARE_SQL} || '/menu' AS menu,
          {_BARE_SQL} || '/home ' || {_BARE_SQL} || '/' AS homes,
          'http://' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS with_scheme, left(md5(url), 16) AS key FROM pages""",
    "spa_pages": f"""
        WITH m AS (SELECT page_id, CASE WHEN page_id % 9 = 0
            THEN '<meta name="generator" content="Squarespace">' || html
            WHEN page_id % 9 = 1 THEN '<p>Loading</p>' ELSE html END AS html FROM pages),
        t AS (SELECT page_id, {_text_sql('html')} AS text, regexp_matches(lower(html),
            'wix\\.com website builder|squarespace|webflow|shopify|duda|weebly') AS script_shell FROM m)
        SELECT page_id, script_shell, length(text) < 300 OR script_shell AS needs_render FROM t""",
    "rendered_text": f"""
        SELECT page_id, md5(nullif(CASE WHEN page_id % 3 = 0 THEN t || '!'
            WHEN page_id % 3 = 1 AND length(left(t, 10)) > length(t) THEN left(t, 10) ELSE t END, '')) AS text_md5
        FROM (SELECT page_id, {_text_sql('html')} AS t FROM pages)""",
    "page_candidates": f"""
        SELECT page_id, CASE WHEN page_id % 7 = 0 THEN {_ROOT_SQL} || '/specials'
            WHEN page_id % 6 = 0 THEN {_ROOT_SQL} || '/happyhourpage'
            WHEN page_id % 4 = 0 THEN {_ROOT_SQL} || '/menu' ELSE {_ROOT_SQL} END AS page_url,
          CAST(CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 6 = 0 THEN 1 WHEN page_id % 4 = 0 THEN 2 ELSE 3 END AS INT)
            AS tier FROM pages WHERE page_id % 10 <> 9""",
    "page_fallback": f"""
        WITH b AS (SELECT page_id, {_ROOT_SQL} AS root, page_id % 5 * 90 AS own, page_id * 37 % 500 AS home FROM pages
          WHERE page_id % 10 <> 9),
        c AS (SELECT *, CASE WHEN own < 300 AND page_id % 5 = 0 AND home > own THEN 'h'
            WHEN own < 300 AND page_id % 3 = 0 AND home > own THEN 'r' ELSE '' END AS how FROM b)
        SELECT page_id, root || CASE how WHEN 'h' THEN '/home' WHEN 'r' THEN '/' ELSE '/menu' END AS page_url,
          CAST(CASE WHEN how = '' THEN own ELSE home END AS INT) AS n_chars,
          CASE WHEN how <> '' THEN 'y' WHEN own > 0 THEN 'x' ELSE '' END AS kind FROM c""",
    "page_lookup": """
        SELECT page_id, left(md5(CASE WHEN page_id % 4 = 0 THEN url || 'x' ELSE url END), 16) AS page_key,
          CASE WHEN page_id % 4 <> 0 THEN md5(html) END AS html_md5 FROM pages""",
    "image_candidates": " UNION ALL ".join(
        f"SELECT page_id, CAST({i} AS INT) AS ord, {address} AS url FROM pages" for i, address in enumerate([
            f"{_SCHEME_SQL} || '://' || {_HOST_SQL} || '/img/' || page_id || '.jpg?w=900'",
            f"{_SCHEME_SQL} || '://' || {_HOST_SQL} || '/img/large-' || page_id || '.webp'",
            "'https://x.example/a.png'",
            "regexp_extract(regexp_replace(url, '[?#].*$', ''), '^.*/') || 'bg' || page_id || '.png'",
        ])
    ),
    "focus_windows": derived.with_sql(
        _FOCUS_SQL,
        """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS ord, CAST(s AS INT) AS s,
             CAST(e AS INT) AS e FROM windows""",
    ),
    "focused_texts": derived.with_sql(
        _FOCUS_SQL,
        """SELECT doc_id, CAST(length(coalesce(t, text)) AS INT) AS n_chars, md5(coalesce(t, text)) AS text_md5
           FROM documents LEFT JOIN cut USING (doc_id)""",
    ),
    "grounding_check": rf"""
        WITH n AS (SELECT doc_id - 1 AS doc_id, '$5 ' || array_to_string(string_split(text, ' ')[1:2], ' ') AS name
          FROM documents),
        c AS (SELECT doc_id, name, lower(text) AS body,
            lower(trim(regexp_replace(name, '\$[0-9.]+', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS bare
          FROM documents JOIN n USING (doc_id))
        SELECT doc_id, name, bare <> '' AND (contains(body, bare) OR len(list_filter(
            string_split_regex(bare, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 3 AND contains(body, w)
              AND w NOT IN ({", ".join(f"'{w}'" for w in focus.STOP_WORDS)}))) > 0) AS grounded FROM c""",
    "place_documents_flat": derived.with_sql(
        [derived.PLACES_SQL],
        f"""SELECT place_id, restaurant_name, address, phone_number, website_url, {_FLAT_HOURS} AS happy_hour_times,
              regular_hours, CASE WHEN k % 10 = 0 THEN '' ELSE rating END AS rating,
              CASE WHEN k % 8 = 0 OR k % 50 = 0 THEN '' ELSE CAST(k % 50 AS VARCHAR) END AS review_count, price_level,
              CASE WHEN {_FLAT_HOURS} <> '' THEN 'Google Places API (Happy Hours)' ELSE 'Google Places API' END AS source,
              CASE WHEN lat IS NULL THEN '' ELSE latitude END AS latitude,
              CASE WHEN lat IS NULL THEN '' ELSE longitude END AS longitude, '' AS generative_summary
            FROM places WHERE place_id <> ''""",
    ),
    "category_filter": derived.with_sql(
        [derived.PLACES_SQL],
        "SELECT k FROM places WHERE NOT (k % 9 IN (0, 3, 4, 5) AND k % 6 NOT IN (0, 1))",
    ),
    "documents_within": area_queries.ORACLE["radius_filter"].replace("SELECT k, lat, lng FROM places", "SELECT k FROM places"),
    "gap_keywords": derived.with_sql(
        [derived.PLACES_SQL, *area_queries.quadtree_sql()],
        "SELECT path, CAST(i AS INT) AS ord, keyword FROM leaves, (VALUES " + ", ".join(
            f"({i}, '{w}')" for i, w in enumerate(MORE_KEYWORDS)) + ") v(i, keyword)",
    ),
    "response_parse": derived.with_sql(
        [derived.PLACES_SQL],
        f"""SELECT k, CASE WHEN {_MENU_OK} THEN '$' || (k % 9) || ' Street ' || (k % 4) END AS drink,
              CASE WHEN {_MENU_OK} THEN k % 9 + CAST(0.5 AS DOUBLE) END AS drink_price,
              CASE WHEN {_MENU_OK} AND k % 3 <> 0 THEN 'unicorn' END AS food,
              CASE WHEN {_MENU_OK} THEN 's' || (k % 5) ELSE '' END AS summary,
              CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 3 END AS INT) AS n_hours,
              CASE k % 4 WHEN 1 THEN 'medium' WHEN 3 THEN 'none' ELSE 'low' END AS confidence FROM places""",
    ),
    "hours_applied": derived.with_sql(
        [derived.PLACES_SQL, "a AS (SELECT *, k % 4 = 1 AND k % 5 <> 0 AS extracted FROM places)"],
        """SELECT k, CASE WHEN extracted THEN 'Monday: 3 - 6 PM | Friday: 4 - 7 PM' ELSE happy_hour_times END
             AS happy_hour_times,
             CASE WHEN extracted THEN 'Website (AI parsed, medium confidence)' ELSE source END AS source, extracted FROM a""",
    ),
    "menus_applied": derived.with_sql(
        [derived.PLACES_SQL, f"a AS (SELECT *, {_MENU_OK} AS extracted FROM places)"],
        """SELECT k, CASE WHEN extracted THEN '$' || (k % 9) || ' Street ' || (k % 4) END AS cheapest_drink,
             CASE WHEN extracted THEN k % 9 + CAST(0.5 AS DOUBLE) END AS cheapest_drink_price,
             CAST(NULL AS VARCHAR) AS cheapest_food, CAST(NULL AS DOUBLE) AS cheapest_food_price,
             CASE WHEN extracted THEN 's' || (k % 5) ELSE '' END AS menu_summary,
             CASE WHEN extracted THEN website_url END AS menu_url, extracted FROM a""",
    ),
    "image_menus_applied": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k, CASE WHEN k % 3 = 1 THEN '' END AS cheapest_drink,
             CASE WHEN k % 3 = 1 THEN CAST(k % 9 AS DOUBLE) END AS cheapest_drink_price,
             CASE WHEN k % 3 <> 1 THEN 'Seen' END AS cheapest_food,
             CASE WHEN k % 3 <> 1 THEN CAST(k % 5 AS DOUBLE) END AS cheapest_food_price,
             CASE WHEN k % 3 = 1 THEN 't' ELSE 'i' END AS menu_summary,
             CASE WHEN k % 3 = 2 THEN website_url || '/first' ELSE website_url END AS menu_url, true AS extracted FROM places""",
    ),
    "image_hours_applied": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k, 'Monday: 3 PM - 5 PM' AS happy_hour_times, CASE WHEN k % 3 = 1 THEN 'Website (AI parsed, high confidence)'
             ELSE 'Website image (AI parsed, medium confidence)' END AS source, true AS extracted FROM places""",
    ),
    "hours_prompts": derived.with_sql(
        _CHOSEN_SQL,
        "SELECT page_id, page_url, CAST(length(text) AS INT) AS text_chars, md5("
        + derived.sql_text(extraction.HOURS_TEMPLATE).replace("{text}", "' || text || '")
        + ") AS prompt_md5 FROM chosen WHERE length(text) > 0",
    ),
    "prompt_texts": derived.with_sql(
        [derived.PLACES_SQL],
        f"SELECT k, {_menu_prompt_sql('address')} AS menu_prompt, "
        + derived.sql_text(extraction.HOURS_TEMPLATE).replace("{text}", "' || address || '")
        + " AS hours_prompt FROM places",
    ),
    "menu_prompts": derived.with_sql(
        [
            *_CHOSEN_SQL,
            "usable AS (SELECT * FROM chosen WHERE length(text) >= 100)",
            *_focus_sql("usable", "page_id", focus.WINDOW_BEFORE, focus.WINDOW_AFTER),
            "final AS (SELECT page_id, page_url, coalesce(t, text) AS text FROM usable LEFT JOIN cut USING (page_id))",
        ],
        f"""SELECT f.page_id, page_url, CAST(length(text) AS INT) AS text_chars, md5({_menu_prompt_sql('text')}) AS prompt_md5
            FROM final f JOIN places p ON p.k = f.page_id""",
    ),
    "image_prompts": f"""
        {_IMAGE_SITES_SQL}
        SELECT page_id, page_url, images, {_template_sql(extraction.MENU_IMAGE_TEMPLATE, name="'Venue ' || page_id",
          schedule="CASE WHEN page_id % 2 = 0 THEN 'Known hours: Friday: 4 - 6 PM, seat ' || page_id || chr(10) ELSE '' END")} AS prompt
        FROM shown WHERE page_id % 3 <> 1 AND page_id % 8 <> 4""",
    "hours_image_prompts": f"""
        {_IMAGE_SITES_SQL}
        SELECT page_id, page_url, images, {_template_sql(extraction.HOURS_IMAGE_TEMPLATE, name="'Venue ' || page_id")} AS prompt
        FROM shown WHERE page_id % 5 <> 0""",
    "full_refresh": _refresh_sql("k IN (SELECT l_orderkey FROM lineitem)"),
    "full_refresh_capped": _refresh_sql(
        "k IN (SELECT k FROM capped)",
        f"""
capped AS (
  SELECT k FROM (
    SELECT l_orderkey AS k, 'P' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS id,
      min((l_linenumber % 5) * 1000000000000 + (l_partkey // 20) * 20 + l_partkey % 20) AS hit
    FROM lineitem GROUP BY l_orderkey)
  WHERE id NOT IN (SELECT place_id FROM recent) ORDER BY hit, id LIMIT {MOST_RESULTS}
)""",
    ),
    "csv_round_trip": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT nullif(place_id, '') AS place_id, restaurant_name, CASE WHEN trim(happy_hour_times) <> '' THEN happy_hour_times END AS happy_hour_times,
             nullif(review_count, '') AS review_count, CASE WHEN k % 7 <> 0 THEN k % 9 / 2 END AS cheapest_drink_price,
             '' AS google_maps_url, CAST(NULL AS VARCHAR) AS menu_url
           FROM places""",
    ),
    "enriched_site": derived.with_sql(
        [derived.PLACES_SQL, derived.OVERRIDES_SQL, derived.MENU_SQL, directory_queries.OVERRIDE_SQL,
         directory_queries.MENU_HIT_SQL, area_queries.BOXES_SQL, area_queries.REGION_SQL],
        """SELECT p.k AS ord, CASE WHEN o.happy_hour_times <> '' THEN o.happy_hour_times ELSE p.happy_hour_times END
             AS happy_hour_times,
             CASE WHEN o.happy_hour_times <> '' THEN CASE WHEN o.source <> '' THEN o.source ELSE 'Manual Override' END
               ELSE p.source END AS source, p.neighborhood,
             nullif(m.cheapest_drink, '') AS cheapest_drink,
             TRY_CAST(nullif(m.cheapest_drink_price, '') AS DOUBLE) AS cheapest_drink_price,
             CASE WHEN mh.ord IS NOT NULL THEN nullif(m.menu_summary, '') ELSE p.menu_summary END AS menu_summary
           FROM regioned p JOIN ov_hit oh USING (k) LEFT JOIN overrides o ON o.ord = oh.ord
           JOIN menu_hit mh USING (k) LEFT JOIN menu m ON m.ord = mh.ord""",
    ),
}
ORACLE["document_round_trip"] = ORACLE["place_documents_flat"]
