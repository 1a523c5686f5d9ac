"""Menu items: cheapest per category, price-ordered summaries, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.focus import first_price
from ..functions.text import let


def cheapest_per_group(
    items: DataFrame, keys: list[str], order: str = "item_ord", categories: tuple[str, ...] = ("drink", "food")
) -> DataFrame:
    """Name and price of the cheapest item of each category; the first listed wins a tie.

    Items without a price are ignored. The minimum of (price, position, name)
    combines before the shuffle, so a place with very many items is no burden.
    """
    best = {
        c: F.min(
            F.when(
                (F.col("category") == c) & F.col("price").isNotNull(), F.struct("price", order, "name")
            )
        ).alias(c)
        for c in categories
    }
    grouped = items.groupBy(*keys).agg(*best.values())
    columns = []
    for c in categories:
        columns += [F.col(f"{c}.name").alias(f"cheapest_{c}"), F.col(f"{c}.price").alias(f"cheapest_{c}_price")]
    return grouped.select(*keys, *columns)


def option_summary(food: Column, drink: Column) -> Column:
    """Options by price, ``a, b and c``; food before drinks at the same price."""
    ranked = F.array_sort(
        F.transform(
            F.concat(food, drink), lambda text, i: F.struct(first_price(text).alias("price"), i.alias("i"), text.alias("text"))
        )
    )

    def phrase(options: Column) -> Column:
        size = F.size(options)
        return F.when(size <= 2, F.array_join(options, " and ")).otherwise(
            F.concat(
                F.array_join(F.slice(options, 1, F.greatest(size - 1, F.lit(0))), ", "), F.lit(" and "),
                F.element_at(options, -1),
            )
        )

    return let(F.transform(ranked, lambda x: x["text"]), phrase)


def number_text(value: Column) -> Column:
    """5.0 is ``5``, 5.5 is ``5.5``."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def priced_label(item: Column) -> Column:
    """``$5 Lager`` of ``struct<name, price>``; empty without an item."""
    return F.when(
        item.isNotNull(),
        F.concat(F.lit("$"), F.coalesce(number_text(item["price"]), F.lit("null")), F.lit(" "), F.coalesce(item["name"], F.lit(""))),
    ).otherwise("")


def menu_rows(answers: DataFrame, drink: str = "drink", food: str = "food") -> DataFrame:
    """Menu columns and option lists of one answer per place."""
    def options(label: Column) -> Column:
        return F.filter(F.array(label), lambda x: x != "")

    d, f = F.col(drink), F.col(food)
    return answers.withColumns({
        "cheapest_drink": priced_label(d), "cheapest_drink_price": d["price"],
        "cheapest_food": priced_label(f), "cheapest_food_price": f["price"],
        "all_drink_options": options(priced_label(d)), "all_food_options": options(priced_label(f)),
    })
