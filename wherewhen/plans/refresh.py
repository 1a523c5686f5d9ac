"""A batch refresh and the page build as single jobs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Box
from ..functions.text import lenient_double
from ..operators.documents import exclude_categories, flatten_places
from ..operators.incremental import fresh_ids, skip_fresh
from ..operators.keyed import apply_overrides, attach_menu, dedup_first
from ..operators.merge import restore_skipped, survivorship_merge
from ..operators.proximity import first_rows
from ..operators.regions import assign_region, assign_region_table
from ..schema import NEIGHBORHOODS


def refresh(
    existing: DataFrame, search_results: DataFrame, documents: DataFrame, as_of: datetime | str,
    stale_days: int = 30, max_results: int | None = None, hit_order: tuple[str, ...] = ("keyword_ord", "page", "pos"),
) -> DataFrame:
    """Search hits and place documents merged into a directory.

    Hits are reduced to first occurrences, fresh places are skipped and put
    back untouched, excluded categories dropped, the rest merged. With
    ``stale_days`` 0 everything was asked for again, so places that did not
    come back are pruned. There is no cap on candidates unless one is given.
    """
    found = dedup_first(search_results, "place_id", list(hit_order))
    fresh = fresh_ids(existing, as_of, stale_days)
    wanted = skip_fresh(found, fresh)
    if max_results is not None:
        wanted = first_rows(wanted, [*hit_order, "place_id"], max_results)
    # The hit order as one number, an error where it does not fit; restored rows come after all of it.
    bits = 62 // len(hit_order)
    rank = F.lit(0).cast("long")
    for column in hit_order:
        part = F.col(column).cast("long")
        fits = part.isNull() | part.between(0, (1 << bits) - 1)
        refused = F.raise_error(F.lit(f"refresh: {column} is not below 2^{bits}")).cast("long")
        rank = rank * (1 << bits) + F.when(fits, part).otherwise(refused)
    ranked = wanted.select(F.col("place_id").alias("id"), rank.alias("ord"))
    kept = exclude_categories(documents.join(ranked, "id"))
    day = date.fromisoformat(str(as_of)[:10]).isoformat()
    fetched = flatten_places(kept, carry=["ord"]).withColumn("freshness_date", F.lit(day))
    columns = [c for c in fetched.columns if c in existing.columns]
    late = existing.select(*columns).withColumn("ord", F.lit(1 << 62) + F.col("ord"))
    new = restore_skipped(fetched.select(*columns), late, fresh)
    return survivorship_merge(existing.select(*columns), new, prune=stale_days == 0)


def enrich(
    places: DataFrame, overrides: DataFrame, menu: DataFrame, boxes: list[Box] | DataFrame | None = None, order: str = "ord"
) -> DataFrame:
    """What the site shows: overrides, neighborhood and menu on every place.

    ``boxes`` is a short list or a table (``boxes_frame``) of any length.
    """
    placed = places.withColumns({
        "lat": lenient_double(F.col("latitude")), "lng": lenient_double(F.col("longitude")),
    })
    placed = apply_overrides(placed, overrides, order)
    if isinstance(boxes, DataFrame):
        with_region = assign_region_table(placed, boxes)
    else:
        with_region = assign_region(placed, NEIGHBORHOODS if boxes is None else boxes)
    return attach_menu(with_region, menu, order)
