"""The two sides of model extraction: prompts out, answers in.

Calling the model is somebody else's job. ``build_*_prompts`` makes the table of
prompts from places and pages; ``apply_*_responses`` takes the table of answers
and decides, row by row, what of it is believed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.focus import focused_text, is_grounded
from ..functions.jsontext import parse_hours, parse_menu
from ..functions.markup import MIN_TEXT
from ..functions.schedule import schedule_from_items
from ..functions.text import filled, not_blank, trim_space
from ..functions.urls import strip_query
from ..operators.keyed import first_per_key, lookup
from ..operators.pages import choose_site_page, site_addresses, site_images, site_texts

MENU_TEMPLATE = (
    "Venue: {name}\n{schedule}List the cheapest drink and the cheapest dish that are on special in the text "
    "below. Answer as JSON with the keys drink, food (each name and price, or null) and short_summary. "
    "Use only what the text says.\n\n{text}"
)
HOURS_TEMPLATE = (
    "Read the weekly special hours from the text below. Answer as JSON with the keys happy_hours (a list of day "
    "and times) and confidence (high, medium, low or none).\n\n{text}"
)
MENU_IMAGE_TEMPLATE = (
    "The images are from the site of this venue: {name}\n{schedule}List the cheapest drink and the cheapest dish "
    "that are on special in them. Answer as JSON with the keys drink, food (each name and price, or null) and "
    "short_summary. Use only what the images show."
)
HOURS_IMAGE_TEMPLATE = (
    "The images are from the site of this venue: {name}\nRead the weekly special hours from them, not the opening "
    "hours. Answer as JSON with the keys happy_hours (a list of day and times) and confidence (high, medium, low or "
    "none)."
)
# Confidence words that reject an answer.
REJECTED = ["low", "none"]


def fill_template(template: str, **values: Column) -> Column:
    """Template text with named places filled from columns.

    The text between the places is constant, so values that look like places
    are not filled again.
    """
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.coalesce(values[name], F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def schedule_block(schedule: Column) -> Column:
    return F.when(
        not_blank(schedule), F.concat(F.lit("Known hours: "), trim_space(schedule), F.lit("\n"))
    ).otherwise("")


def menu_prompt(name: Column, text: Column, schedule: Column) -> Column:
    return fill_template(MENU_TEMPLATE, name=name, text=text, schedule=schedule_block(schedule))


def hours_prompt(text: Column) -> Column:
    return fill_template(HOURS_TEMPLATE, text=text)


def read_sites(places: DataFrame, pages: DataFrame, **page_options) -> DataFrame:
    """``base, page_url, first_url, text`` for the distinct websites of the places.

    All of it depends on the website only, so places that share one are counted
    once. Pages are chosen by address alone, and texts read afterwards.
    """
    return site_texts(choose_site_page(site_addresses(places), pages, **page_options), pages)


def _place_texts(places: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """The text of its website for every place whose website has one."""
    visited = places.filter(filled(F.col("website_url"))).withColumn("__base", strip_query(F.col("website_url")))
    columns = ["page_url", "first_url", "text"]
    found = lookup(visited, sites, F.col("__base"), "base", "__site", keys, columns)
    return found.filter(F.col("__site").isNotNull()).select(*places.columns, *[f"__site.{c}" for c in columns])


def build_menu_prompts(
    places: DataFrame, pages: DataFrame, keys: list[str], anchors: list[str] | None = None, **page_options
) -> DataFrame:
    """``keys, page_url, first_url, text, prompt`` for pages that say enough."""
    sites = read_sites(places, pages, **page_options).filter(F.length("text") >= MIN_TEXT)
    focused = sites.withColumn("text", focused_text(F.col("text"), anchors))
    return _place_texts(places, focused, keys).select(
        *keys, "page_url", "first_url", "text",
        menu_prompt(F.col("restaurant_name"), F.col("text"), F.col("happy_hour_times")).alias("prompt"),
    )


def build_hours_prompts(places: DataFrame, pages: DataFrame, keys: list[str], **page_options) -> DataFrame:
    """As ``build_menu_prompts`` for weekly hours; any text will do and all of it is shown."""
    sites = read_sites(places, pages, **page_options).filter(F.length("text") > 0)
    return _place_texts(places, sites, keys).select(
        *keys, "page_url", "first_url", "text", hours_prompt(F.col("text")).alias("prompt")
    )


def _image_prompts(places: DataFrame, chosen: DataFrame, pages: DataFrame, keys: list[str], prompt: Column, limit: int | None) -> DataFrame:
    """``keys, page_url, images, prompt`` for the places whose chosen page shows images."""
    visited = places.filter(filled(F.col("website_url"))).withColumn("__base", strip_query(F.col("website_url")))
    found = lookup(visited, site_images(chosen, pages, limit), F.col("__base"), "base", "__site", keys, ["page_url", "images"])
    return found.filter(F.col("__site").isNotNull()).select(*keys, "__site.page_url", "__site.images", prompt.alias("prompt"))


def build_menu_image_prompts(places: DataFrame, pages: DataFrame, keys: list[str], limit: int | None = None, **page_options) -> DataFrame:
    """One prompt with the images of the chosen page, for places whose website has no text at all.

    A site with some text, be it too short to be asked about, is not tried by its
    images; nor is one without images. ``limit`` keeps the first so many.
    """
    sites = choose_site_page(site_addresses(places), pages, **page_options)
    read = site_texts(sites, pages).filter(F.length("text") > 0).select("base")
    prompt = fill_template(
        MENU_IMAGE_TEMPLATE, name=F.col("restaurant_name"), schedule=schedule_block(F.col("happy_hour_times"))
    )
    return _image_prompts(places, sites.join(read, "base", "left_anti"), pages, keys, prompt, limit)


def build_hours_image_prompts(
    places: DataFrame, pages: DataFrame, keys: list[str], responses: DataFrame, order: str | None = None,
    limit: int | None = None, **page_options,
) -> DataFrame:
    """As ``build_menu_image_prompts`` for weekly hours: places without an answer to their text, or one without confidence.

    ``responses`` are the answers to ``build_hours_prompts``; a confident answer
    that lists no hours is believed, and its place not asked again.
    """
    sure = last_answers(responses, keys, order).select(*keys, parse_hours(F.col("response")).alias("__answer")).filter(
        ~F.coalesce("__answer.confidence", F.lit("low")).isin(REJECTED)
    )
    open_places = places.join(sure.select(*keys), keys, "left_anti")
    sites = choose_site_page(site_addresses(open_places), pages, **page_options)
    return _image_prompts(open_places, sites, pages, keys, fill_template(HOURS_IMAGE_TEMPLATE, name=F.col("restaurant_name")), limit)


def _present(item: Column) -> Column:
    return item.isNotNull() & (item["name"].isNotNull() | item["price"].isNotNull())


def _believed(item: Column, text: Column) -> Column:
    """An item without a name cannot be checked; a named one has to be in the text."""
    return F.when(_present(item) & (~filled(item["name"]) | is_grounded(item["name"], text)), item)


def last_answers(responses: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One answer per key: the last by ``order``; the greatest text where that leaves several."""
    ranking = [F.col(c).desc_nulls_last() for c in ([order] if order else []) + ["response"]]
    return first_per_key(responses.select(*keys, *([order] if order else []), "response"), keys, ranking)


def apply_menu_responses(
    places: DataFrame, prompts: DataFrame, responses: DataFrame, keys: list[str],
    image_responses: DataFrame | None = None, order: str | None = None,
) -> DataFrame:
    """Menu columns from believed answers; ``extracted`` tells where one was found.

    Answers from text are checked against the text the model saw. Where they
    leave nothing, or there are none, an answer from images is taken as it is. An
    answered place without any item loses its summary; one that was not asked keeps
    its own. A place whose page had no text gets its website as address of the menu.
    Of repeated answers the last by ``order`` counts.
    """
    answered = last_answers(responses, keys, order).select(*keys, parse_menu(F.col("response")).alias("__answer")).join(
        prompts.select(*keys, "text", "page_url", "first_url"), keys
    ).select(
        *keys, "page_url", "first_url", F.col("__answer.short_summary").alias("__summary"),
        _believed(F.col("__answer.drink"), F.col("text")).alias("__drink"),
        _believed(F.col("__answer.food"), F.col("text")).alias("__food"),
    )
    if image_responses is not None:
        seen = last_answers(image_responses, keys, order).select(*keys, parse_menu(F.col("response")).alias("__image"))
        found = F.col("__drink").isNotNull() | F.col("__food").isNotNull()
        drink, food = F.col("__image.drink"), F.col("__image.food")
        answered = answered.join(seen, keys, "full").select(
            *keys, "first_url", F.when(found, F.col("page_url")).otherwise(F.col("first_url")).alias("page_url"),
            F.when(found, F.col("__summary")).otherwise(F.coalesce("__image.short_summary", F.lit(""))).alias("__summary"),
            F.when(found, F.col("__drink")).when(_present(drink), drink).alias("__drink"),
            F.when(found, F.col("__food")).when(_present(food), food).alias("__food"),
        )
    drink, food = F.col("__drink"), F.col("__food")
    any_item = drink.isNotNull() | food.isNotNull()
    website = F.col("website_url") if "website_url" in places.columns else F.lit(None).cast("string")
    asked = F.coalesce(F.col("__asked"), F.lit(False))
    joined = places.join(answered.withColumn("__asked", F.lit(True)), keys, "left")
    out = joined.withColumns({
        "cheapest_drink": F.when(drink.isNotNull(), F.coalesce(drink["name"], F.lit(""))).otherwise(F.col("cheapest_drink")),
        "cheapest_drink_price": F.when(drink.isNotNull(), drink["price"]).otherwise(F.col("cheapest_drink_price")),
        "cheapest_food": F.when(food.isNotNull(), F.coalesce(food["name"], F.lit(""))).otherwise(F.col("cheapest_food")),
        "cheapest_food_price": F.when(food.isNotNull(), food["price"]).otherwise(F.col("cheapest_food_price")),
        "menu_summary": F.when(asked, F.when(any_item, F.col("__summary")).otherwise("")).otherwise(F.col("menu_summary")),
        "menu_url": F.when(any_item, F.coalesce("page_url", website)).otherwise(F.col("menu_url")),
        "extracted": any_item,
    })
    return out.select(*places.columns, "extracted")


def _hours_accepted(answer: Column) -> Column:
    return ~answer["confidence"].isin(REJECTED) & (F.size(answer["happy_hours"]) > 0)


def apply_hours_responses(
    places: DataFrame, responses: DataFrame, keys: list[str], image_responses: DataFrame | None = None,
    order: str | None = None,
) -> DataFrame:
    """Schedule and source from confident answers; ``extracted`` tells where.

    An answer of low confidence, or none at all, gives way to one from images. Of
    repeated answers the last by ``order`` counts.
    """
    sides = [(responses, "__text", "Website")]
    if image_responses is not None:
        sides.append((image_responses, "__image", "Website image"))
    joined, schedule, source = places, None, None
    for answers, name, label in sides:
        parsed = last_answers(answers, keys, order).select(*keys, parse_hours(F.col("response")).alias(name))
        joined = joined.join(parsed, keys, "left")
        answer = F.col(name)
        usable = F.coalesce(_hours_accepted(answer), F.lit(False))
        if name == "__image":
            usable = usable & F.coalesce(F.col("__text.confidence"), F.lit("low")).isin(REJECTED)
        text = F.when(usable, schedule_from_items(answer["happy_hours"]))
        made = F.when(usable, F.concat(F.lit(f"{label} (AI parsed, "), answer["confidence"], F.lit(" confidence)")))
        schedule = text if schedule is None else F.coalesce(schedule, text)
        source = made if source is None else F.coalesce(source, made)
    return joined.withColumns({
        "extracted": source.isNotNull(),
        "happy_hour_times": F.coalesce(schedule, F.col("happy_hour_times")),
        "source": F.coalesce(source, F.col("source")),
    }).select(*places.columns, "extracted")
