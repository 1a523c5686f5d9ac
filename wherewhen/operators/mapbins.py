"""Map clusters and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import has_position, pixel_x, pixel_y

# Cell side in pixels at the reference zoom, and where clustering ends.
CELL_PIXELS = 20
REFERENCE_ZOOM = 13
NO_CLUSTER_ZOOM = 15


def with_map_cell(points: DataFrame, zoom: int, cell_pixels: int = CELL_PIXELS) -> DataFrame:
    """Adds ``cell_x``/``cell_y`` to the points that have a position.

    This is also the membership of clusters in long form: members of a cluster
    are the points with its cell, never a list in one row.
    """
    side = cell_pixels * 2.0 ** (REFERENCE_ZOOM - zoom)
    return points.filter(has_position(F.col("lat"), F.col("lng"))).withColumns({
        "cell_x": F.floor(pixel_x(F.col("lng"), zoom) / side),
        "cell_y": F.floor(pixel_y(F.col("lat"), zoom) / side),
    })


def cluster_points(points: DataFrame, zoom: int, key: str, active: str = "active") -> DataFrame:
    """Clusters and single points as they appear on the map.

    ``kind`` is ``cluster`` or ``single``; only singles have the point's key.
    At high zoom every point is single and nothing is grouped.
    """
    cells = with_map_cell(points, zoom)
    if zoom >= NO_CLUSTER_ZOOM:
        return cells.select(
            F.lit("single").alias("kind"), "cell_x", "cell_y", F.lit(1).cast("long").alias("n_points"),
            "lat", "lng", F.col(active).alias("has_active"), F.col(key).alias("point_key"),
        )
    grouped = cells.groupBy("cell_x", "cell_y").agg(
        F.count("*").alias("n_points"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"),
        F.max(active).alias("has_active"), F.min(key).alias("__key"),
    )
    single = F.col("n_points") == 1
    return grouped.select(
        F.when(single, "single").otherwise("cluster").alias("kind"), "cell_x", "cell_y", "n_points",
        "lat", "lng", "has_active", F.when(single, F.col("__key")).alias("point_key"),
    )


def bounds(points: DataFrame) -> DataFrame:
    """Bounding box of the points that have a position."""
    return points.filter(has_position(F.col("lat"), F.col("lng"))).agg(
        F.min("lat").alias("south"), F.min("lng").alias("west"),
        F.max("lat").alias("north"), F.max("lng").alias("east"),
    )
