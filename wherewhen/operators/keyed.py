"""Ordered choice per key, and lookups that survive crowded or missing keys.

The first or last row of a key is a rank filter. Spark turns ``rank <= n``
into a limit every task applies before the shuffle, so a key that holds a third
of all rows sends ``n`` rows per task, not all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, trimmed_key

_RANK = "__rank"


def first_per_key(rows: DataFrame, keys: list[str], order: list, limit: int = 1) -> DataFrame:
    """The first ``limit`` rows of every key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) <= limit).drop(_RANK)


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Later rows replace earlier ones of the same key."""
    return first_per_key(rows, keys, [F.col(order).desc()])


def dedup_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """First occurrence of every non-blank key."""
    return first_per_key(rows.filter(filled(F.col(key).cast("string"))), [key], order)


def union_tiers(*tiers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Union where an earlier argument wins over a later one for the same key."""
    tagged = [tier.withColumn("tier", F.lit(i)) for i, tier in enumerate(tiers)]
    merged = tagged[0]
    for tier in tagged[1:]:
        merged = merged.unionByName(tier)
    return dedup_first(merged, key, ["tier", *order])


def upsert(existing: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Whole-row replacement by id, or by name where there is no id; last wins."""
    key = F.coalesce(trimmed_key(F.col("place_id")), F.col("restaurant_name"))
    both = existing.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    keyed = both.withColumn("__key", key)
    chosen = first_per_key(keyed, ["__key"], [F.col("__side").desc(), F.col(order).desc()])
    return chosen.drop("__key", "__side")


def spread_key(key: Column, *seeds: Column) -> Column:
    """A join key for the left side of a left join.

    Rows without a key can never match, but as NULLs they would all hash to one
    task. Each gets a value of its own instead, outside the range of real keys.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*seeds).cast("string")))


def splittable_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Equi-join whose crowded left keys Spark can split at run time.

    A right side that was just grouped by the key is already partitioned by it.
    Spark would join it in place, and then cannot divide a crowded partition of
    the left side. The hashed key as a second join column makes both sides
    exchange for the join, which is where skew is detected.
    """
    hashed, keys = "__key_hash", [on] if isinstance(on, str) else on
    return left.withColumn(hashed, F.xxhash64(*keys)).join(
        right.withColumn(hashed, F.xxhash64(*keys)), [*keys, hashed], how
    ).drop(hashed)


def lookup(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: str, into: str, seeds: list[str],
    payload: list[str],
) -> DataFrame:
    """Left join on a key that is unique on the right; the match arrives as a struct.

    No broadcast is forced: Spark broadcasts the right side when its measured
    size allows, and otherwise splits a crowded left key at run time, which is
    safe because each key has a single right row.
    """
    found = right.select(F.col(right_key).alias("__lookup"), F.struct(*payload).alias(into))
    keyed = left.withColumn("__lookup", spread_key(left_key, *[F.col(s) for s in seeds]))
    return splittable_join(keyed, found, "__lookup").drop("__lookup")


def precedence_join(
    left: DataFrame, right: DataFrame, payload: list[str], order: str = "ord", into: str = "hit",
    seeds: list[str] | None = None, named_only: bool = True,
) -> DataFrame:
    """Match by trimmed ``place_id`` first, else by exact ``restaurant_name``.

    Whole rows are chosen, not single columns: a match by id hides a match by
    name even where its values are blank. For a repeated key the last row
    counts, and rows with an id can be found by name too.
    """
    seeds = seeds or ["place_id", "restaurant_name"]
    usable = right.filter(filled(F.col("restaurant_name"))) if named_only else right
    by_id = last_per_key(
        usable.withColumn("__id", trimmed_key(F.col("place_id"))).filter(F.col("__id").isNotNull()),
        ["__id"], order,
    )
    by_name = last_per_key(usable.filter(filled(F.col("restaurant_name"))), ["restaurant_name"], order)
    matched = lookup(left, by_id, trimmed_key(F.col("place_id")), "__id", "__by_id", seeds, payload)
    matched = lookup(
        matched, by_name, F.nullif(F.col("restaurant_name"), F.lit("")), "restaurant_name", "__by_name",
        seeds, payload,
    )
    return matched.withColumn(
        into, F.when(F.col("__by_id").isNotNull(), F.col("__by_id")).otherwise(F.col("__by_name"))
    ).drop("__by_id", "__by_name")


def apply_overrides(
    places: DataFrame, overrides: DataFrame, order: str = "ord", default_source: str = "Manual Override",
    seeds: list[str] | None = None,
) -> DataFrame:
    """Replace schedule, source and date where the chosen override has a schedule."""
    joined = precedence_join(
        places, overrides, ["happy_hour_times", "source", "freshness_date"], order, "__ov", seeds
    )
    applies = filled(F.col("__ov.happy_hour_times"))
    source = F.when(filled(F.col("__ov.source")), F.col("__ov.source")).otherwise(default_source)
    return joined.withColumns({
        "happy_hour_times": F.when(applies, F.col("__ov.happy_hour_times")).otherwise(F.col("happy_hour_times")),
        "source": F.when(applies, source).otherwise(F.col("source")),
        "freshness_date": F.when(
            applies & filled(F.col("__ov.freshness_date")), F.col("__ov.freshness_date")
        ).otherwise(F.col("freshness_date")),
    }).drop("__ov")


MENU_COLUMNS = [
    "cheapest_drink", "cheapest_drink_price", "cheapest_food", "cheapest_food_price", "menu_summary", "menu_url",
]


def attach_menu(
    places: DataFrame, menu: DataFrame, order: str = "ord", seeds: list[str] | None = None
) -> DataFrame:
    """All six menu columns of the matched row, blanks as NULL; own values without a match.

    ``menu`` prices may be text (read leniently) or numbers.
    """
    from ..functions.text import lenient_double

    joined = precedence_join(places, menu, MENU_COLUMNS, order, "__menu", seeds)
    kinds = dict(menu.dtypes)
    columns = {}
    for name in MENU_COLUMNS:
        value = F.col(f"__menu.{name}")
        if name.endswith("_price"):
            value = lenient_double(value) if kinds[name] == "string" else value.cast("double")
            own = F.col(name) if name in places.columns else F.lit(None).cast("double")
        else:
            value = F.nullif(value, F.lit(""))
            own = F.col(name) if name in places.columns else F.lit(None).cast("string")
        columns[name] = F.when(F.col("__menu").isNotNull(), value).otherwise(own)
    return joined.withColumns(columns).drop("__menu")


def name_index(reference: DataFrame, order: str) -> DataFrame:
    """Trimmed name to its first id and the number of rows that carry the name.

    Counts and minima combine before the shuffle; the ids of a name are never
    gathered into a list.
    """
    rows = reference.select(
        trimmed_key(F.col("restaurant_name")).alias("name"), trimmed_key(F.col("place_id")).alias("id"),
        F.col(order).alias("__ord"),
    ).filter(F.col("name").isNotNull() & F.col("id").isNotNull())
    return rows.groupBy("name").agg(
        F.min(F.struct("__ord", "id")).alias("first"), F.count("*").alias("n_ids")
    ).select("name", F.col("first.id").alias("first_id"), "n_ids")


def ambiguous_names(reference: DataFrame, order: str) -> DataFrame:
    """Every (name, id) row of the names that more than one row carries."""
    shared = name_index(reference, order).filter(F.col("n_ids") > 1).select("name", "n_ids")
    rows = reference.select(
        trimmed_key(F.col("restaurant_name")).alias("name"), trimmed_key(F.col("place_id")).alias("place_id"),
        F.col(order).alias("ord"),
    ).filter(F.col("name").isNotNull() & F.col("place_id").isNotNull())
    return splittable_join(rows, shared, "name", "inner")


def key_backfill(
    rows: DataFrame, reference: DataFrame, reference_order: str = "ord", seeds: list[str] | None = None
) -> DataFrame:
    """Fill blank ids from the name index; ``match_status`` tells how.

    ``kept`` (had an id), ``unique``, ``ambiguous`` (first id in file order) or
    ``none`` (stays empty).
    """
    name = trimmed_key(F.col("restaurant_name"))
    has_id = trimmed_key(F.col("place_id")).isNotNull()
    joined = lookup(
        rows, name_index(reference, reference_order), F.when(~has_id, name), "name", "__found",
        seeds or ["restaurant_name", "place_id"], ["first_id", "n_ids"],
    )
    return joined.withColumns({
        "match_status": F.when(has_id, "kept")
        .when(F.col("__found").isNull(), "none")
        .when(F.col("__found.n_ids") > 1, "ambiguous")
        .otherwise("unique"),
        "place_id": F.when(has_id, trimmed_key(F.col("place_id"))).otherwise(
            F.coalesce(F.col("__found.first_id"), F.lit(""))
        ),
    }).drop("__found")
