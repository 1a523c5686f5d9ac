"""Named boxes: which one a point belongs to, and how well each is covered."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Box, has_position
from ..schema import DEFAULT_AREA, POINT_HALF_LAT, POINT_HALF_LNG, SEARCH_AREAS
from .keyed import splittable_join


def select_areas(
    presets: list[str] | None = None, point: tuple[float, float] | None = None,
    box: Box | None = None,
) -> list[Box]:
    """Boxes asked for: named ones, one around a point, a custom one, or the default."""
    if presets:
        unknown = [name for name in presets if name not in SEARCH_AREAS]
        if unknown:
            raise ValueError(f"unknown areas {unknown}; known: {sorted(SEARCH_AREAS)}")
        return [SEARCH_AREAS[name] for name in presets]
    if point:
        lat, lng = point
        return [Box(lat - POINT_HALF_LAT, lng - POINT_HALF_LNG, lat + POINT_HALF_LAT, lng + POINT_HALF_LNG)]
    return [box or DEFAULT_AREA]


def boxes_frame(spark: SparkSession, boxes: list[Box]) -> DataFrame:
    return spark.createDataFrame(
        [(i, b.id, b.label, b.south, b.west, b.north, b.east) for i, b in enumerate(boxes)],
        "ord int, id string, label string, south double, west double, north double, east double",
    )


def assign_region(
    points: DataFrame, boxes: list[Box], into: str = "neighborhood", lat: str = "lat", lng: str = "lng"
) -> DataFrame:
    """First box in list order that contains the point, edges included; else NULL.

    The list becomes one conditional expression: no join, no shuffle. It is
    meant for lists that a person writes; boxes kept as a table go through
    ``assign_region_table``.
    """
    chain = F
    for box in boxes:
        chain = chain.when(box.contains(F.col(lat), F.col(lng)), box.id)
    return points.withColumn(into, chain if boxes else F.lit(None).cast("string"))


def assign_region_table(
    points: DataFrame, boxes: DataFrame, tile_degrees: float = 0.05,
    into: str = "neighborhood", salts: int = 16,
) -> DataFrame:
    """As ``assign_region`` for a table of boxes (distinct ``ord``) of any number and size.

    Tiles have sides of ``tile_degrees``, doubled until no side of the box is
    longer, so a box touches at most four, however large it is. Distinct
    positions stand under their tile of every size that occurs (few: each is
    twice the one before), and the join is on the tile. Boxes are copied
    ``salts`` times so that a tile with a large share of all positions is worked
    on by several tasks. The lowest ``ord`` of a position combines before the
    shuffle; points look their position up, so they need no key of their own.
    """
    side = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(side / tile_degrees)), F.lit(0))).cast("int")
    sized = boxes.where("south <= north AND west <= east").withColumn("__level", level)
    levels = sorted(r[0] for r in sized.select("__level").distinct().collect())
    if not levels:
        return points.withColumn(into, F.lit(None).cast("string"))

    def tile(value):
        return F.floor(value / (tile_degrees * F.pow(F.lit(2.0), F.col("__level"))))

    listed = (
        sized.withColumn("__ty", F.explode(F.sequence(tile(F.col("south")), tile(F.col("north")))))
        .withColumn("__tx", F.explode(F.sequence(tile(F.col("west")), tile(F.col("east")))))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .select("__level", "__ty", "__tx", "__salt", F.col("ord").alias("__ord"), "south", "north", "west", "east")
    )
    lat, lng = F.col("__lat"), F.col("__lng")
    positions = (
        points.filter(has_position(F.col("lat"), F.col("lng")))
        .select(F.col("lat").alias("__lat"), F.col("lng").alias("__lng")).distinct()
        .withColumn("__level", F.explode(F.lit(levels)))
        .withColumns({"__ty": tile(lat), "__tx": tile(lng), "__salt": F.pmod(F.xxhash64(lat, lng), F.lit(salts)).cast("int")})
    )
    hits = positions.join(listed, ["__level", "__ty", "__tx", "__salt"]).filter(
        lat.between(F.col("south"), F.col("north")) & lng.between(F.col("west"), F.col("east"))
    )
    first = hits.groupBy("__lat", "__lng").agg(F.min("__ord").alias("__ord"))
    chosen = first.join(boxes.select(F.col("ord").alias("__ord"), F.col("id").alias(into)), "__ord")
    # Points without a position join nothing, and stay where they are. Of the others a
    # crowded position is split: both sides exchange for the join.
    positioned = has_position(F.col("lat"), F.col("lng"))
    at = chosen.select("__lat", "__lng", into).withColumnsRenamed({"__lat": "lat", "__lng": "lng"})
    placed = splittable_join(points.where(positioned), at, ["lat", "lng"])
    rest = points.where(~F.coalesce(positioned, F.lit(False))).withColumn(into, F.lit(None).cast(chosen.schema[into].dataType))
    return placed.select(*points.columns, into).unionByName(rest)


def tile_degrees_for(boxes: list[Box]) -> float:
    """A tile about as large as a typical box, so that each box touches few tiles."""
    sides = sorted(max(b.north - b.south, b.east - b.west) for b in boxes)
    return max(sides[len(sides) // 2], 1e-6) if sides and math.isfinite(sides[-1]) else 1.0


def region_counts(places: DataFrame, at_least: int = 40, region: str = "neighborhood") -> DataFrame:
    """Regions with enough places."""
    return places.filter(F.col(region).isNotNull()).groupBy(region).agg(
        F.count("*").alias("n_places")
    ).filter(F.col("n_places") >= at_least)


def coverage(places: DataFrame, boxes: DataFrame, at_least: int = 40, region: str = "neighborhood") -> DataFrame:
    """All regions in order, each marked covered or not."""
    counted = region_counts(places, at_least, region).withColumnRenamed(region, "id")
    return boxes.join(counted, "id", "left").select(
        "ord", "id", "label", F.col("n_places").isNotNull().alias("covered")
    )


def in_boxes(points: DataFrame, boxes: list[Box], lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Points in any of the boxes."""
    test = F.lit(False)
    for box in boxes:
        test = test | box.contains(F.col(lat), F.col(lng))
    return points.filter(test)
