"""Distance filters, distance order and nearest neighbours of many centres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_METERS, great_circle, has_position
from ..session import stored
from .keyed import first_per_key


def with_distance(
    points: DataFrame, at: tuple[float, float], radius: float = EARTH_METERS,
    lat: str = "lat", lng: str = "lng", into: str = "distance",
) -> DataFrame:
    """Distance to one point; NULL where the row has no position."""
    return points.withColumn(
        into,
        F.when(
            has_position(F.col(lat), F.col(lng)),
            great_circle(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lng), radius),
        ),
    )


def nearest_first(points: DataFrame, ties: list[str], limit: int | None = None, distance: str = "distance") -> DataFrame:
    """Order by distance, rows without one last, ``ties`` deciding equal ones.

    With a limit every task keeps its own best ``limit`` rows and only those
    travel; without one the order is a range partitioning of all rows.
    """
    return first_rows(points, [F.col(distance).asc_nulls_last(), *ties], limit)


def first_rows(rows: DataFrame, order: list, limit: int | None) -> DataFrame:
    """Rows in order, the first ``limit`` of them if given.

    The order is stated again after the limit: later columns would otherwise be
    moved below the limit, where they hide the top-k from the planner and cause
    a full sort. The second sort sees ``limit`` rows.
    """
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit).orderBy(*order)


def _degree_reach(at_lat: float, meters: float) -> tuple[float, float]:
    """Half height and half width in degrees of a box around a circle."""
    angle = meters / EARTH_METERS
    d_lat = math.degrees(angle) * (1 + 1e-9) + 1e-9
    slice_ = math.cos(math.radians(at_lat))
    ratio = math.sin(min(angle, math.pi / 2)) / slice_ if slice_ > 0 else 2.0
    d_lng = math.degrees(math.asin(ratio)) * (1 + 1e-9) + 1e-9 if ratio < 1 else 360.0
    return d_lat, d_lng


def within_radius(
    points: DataFrame, at: tuple[float, float], meters: float, keep_missing: bool = True,
    lat: str = "lat", lng: str = "lng",
) -> DataFrame:
    """Rows at most ``meters`` away; rows without a position stay by default.

    A box around the circle is tested first, as a filter of its own: on stored
    coordinates the Parquet reader uses it to skip row groups. The distance test
    is null without a position, and must not share a term with the box, or Spark
    would fold both into one condition that it cannot push down.
    """
    la, ln = F.col(lat), F.col(lng)
    d_lat, d_lng = _degree_reach(at[0], meters)
    box = la.between(at[0] - d_lat, at[0] + d_lat)
    if at[1] - d_lng >= -180 and at[1] + d_lng <= 180:
        box = box & ln.between(at[1] - d_lng, at[1] + d_lng)
    near = great_circle(F.lit(at[0]), F.lit(at[1]), la, ln, EARTH_METERS) <= meters
    if not keep_missing:
        return points.filter(box & near)
    return points.filter(la.isNull() | ln.isNull() | box).filter(F.coalesce(near, F.lit(True)))


def _on_sphere(lat: Column, lng: Column) -> Column:
    """The position as x, y, z on a sphere of radius 1: no poles, no seam."""
    lat, lng = F.radians(lat), F.radians(lng)
    return F.struct((F.cos(lat) * F.cos(lng)).alias("x"), (F.cos(lat) * F.sin(lng)).alias("y"), F.sin(lat).alias("z"))


def near_centers(
    points: DataFrame, centers: DataFrame, center_key: str, meters: float, point_keys: list[str],
    k: int | None = None, salts: int = 16,
) -> DataFrame:
    """Pairs of centre and point at most ``meters`` apart; the ``k`` nearest if given.

    Without ``k`` the result has every pair in reach, so it grows with how crowded
    a reach is. With ``k`` cells beyond the reach are dropped in the search of
    ``nearest_k_any``, so that pairs compared stay in proportion to k.

    All pairs are found in cubes. Positions are points of a sphere in space, which is cut into cubes at least
    one reach wide. Partners lie in the same or a neighbouring cube, so the join
    is an equi-join on the cube, everywhere on the globe. A point is in one
    cube; a centre is copied to those of its 27 that the sphere passes through,
    and ``salts`` times more so that a crowded cube is spread over as many tasks.
    Spark expects far fewer rows than these copies, so both sides are sorted; it
    would send the copies through the driver.
    """
    angle = meters / EARTH_METERS
    if angle > math.pi / 4:
        raise ValueError("radius too large for cell joins")
    if k is not None:
        near = compared_pairs(points, centers, center_key, point_keys, k, meters=meters).filter(F.col("distance") <= meters)
        return _ranked(near, center_key, point_keys, k)
    size = 2 * math.sin(angle / 2) * (1 + 1e-9) + 1e-9
    axes = ("x", "y", "z")
    cells = [f"__c{axis}" for axis in axes]
    p = points.filter(has_position(F.col("lat"), F.col("lng"))).select(
        *point_keys, F.col("lat").alias("__lat"), F.col("lng").alias("__lng"),
        _on_sphere(F.col("lat"), F.col("lng")).alias("__at"),
        F.pmod(F.xxhash64(*point_keys), F.lit(salts)).cast("int").alias("__salt"),
    ).withColumns({c: F.floor(F.col(f"__at.{axis}") / size) for c, axis in zip(cells, axes, strict=True)})
    c = centers.filter(has_position(F.col("lat"), F.col("lng"))).select(
        center_key, F.col("lat").alias("__center_lat"), F.col("lng").alias("__center_lng"),
        _on_sphere(F.col("lat"), F.col("lng")).alias("__center_at"),
    )
    for cell, axis in zip(cells, axes, strict=True):
        own = F.floor(F.col(f"__center_at.{axis}") / size)
        c = c.withColumn(cell, F.explode(F.sequence(own - 1, own + 1)))
    # Squares of how near and how far a cube's points are from the centre of the sphere.
    nearest = sum(F.pow(F.greatest(F.lit(0.0), F.col(i) * size, -(F.col(i) + 1) * size), F.lit(2)) for i in cells)
    farthest = sum(F.pow(F.greatest(F.abs(F.col(i) * size), F.abs((F.col(i) + 1) * size)), F.lit(2)) for i in cells)
    c = c.filter((nearest <= 1 + 1e-9) & (farthest >= 1 - 1e-9))
    c = c.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    chord = sum(F.pow(F.col(f"__at.{axis}") - F.col(f"__center_at.{axis}"), F.lit(2)) for axis in axes)
    return (
        p.join(c.hint("merge"), [*cells, "__salt"])
        # The straight line rules out most neighbours before any trigonometry.
        .filter(chord <= size * size)
        .withColumn("distance", great_circle(F.col("__center_lat"), F.col("__center_lng"), F.col("__lat"), F.col("__lng"), EARTH_METERS))
        .filter(F.col("distance") <= meters)
        .select(center_key, *point_keys, "distance")
    )


def _ranked(pairs: DataFrame, center_key: str, point_keys: list[str], k: int) -> DataFrame:
    """The first ``k`` pairs of every centre, with their rank.

    Spark turns the rank filter into a per-task limit ahead of the shuffle, so
    a centre with very many partners sends k rows per task.
    """
    order = Window.partitionBy(center_key).orderBy("distance", *point_keys)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- the k nearest, however far -------------------------------------------------

# Levels of halving of the cube around the globe at which cells are judged. Cells of
# the last one are about 12 metres wide.
LEVELS = (2, 4, 6, 9, 12, 15, 18, 20)
_BOUNDED_LEVEL = 6  # the sphere passes through some 25,000 cells of this level
_SALT_ROWS = 1 << 13  # points of one cell that one task compares with a centre
_TASK_CENTERS = 1000  # centres whose cells one task holds
_CELLS = ["__cx", "__cy", "__cz"]


def _cell_numbers(at: str, level: int) -> list[Column]:
    """Numbers of the cell of a position, per axis, from 0 to 2^level - 1."""
    last = (1 << level) - 1
    return [
        F.least(F.floor((F.col(f"{at}.{a}") + 1.0) * float(1 << level) / 2).cast("long"), F.lit(last)).alias(n)
        for n, a in zip(_CELLS, ("x", "y", "z"), strict=True)
    ]


def _cell_counts(points: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """``__level``, cell, ``__n``: points per cell and level; coarser levels are added up from the finest."""
    finest = points.select(*_cell_numbers("__at", levels[-1])).groupBy(*_CELLS).agg(F.count("*").alias("__n"))
    every = finest.withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    up = [F.expr(f"shiftright({n}, {levels[-1]} - __level)").alias(n) for n in _CELLS]
    return every.select("__level", *up, "__n").groupBy("__level", *_CELLS).agg(F.sum("__n").alias("__n"))


def nearest_k_any(
    points: DataFrame, centers: DataFrame, center_key: str, point_keys: list[str], k: int, levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """``center_key, *point_keys, distance, rank``: the ``k`` nearest points of every centre, without a radius.

    Positions are points of a sphere in space, in the cells of a cube that is
    halved level by level; points are counted per cell once. Level by level a centre
    holds the cells that can have one of its k nearest: cells in order of their far
    corner that hold k points together bound the k-th distance, and cells that begin
    beyond that bound are dropped. What is left opens into the occupied cells of the
    next level, in an equi-join on the parent cell. A centre in a crowd soon holds
    small cells, one in empty country the near rim of what is far away. Only the
    points of the last cells are compared, so pairs stay in proportion to k. Points of
    one position are equally far from everywhere, so the first k of them by
    ``point_keys`` are all that can be listed; others are left out at the start.

    Centres are dealt out over tasks by their number. Counts of the first levels are
    bounded by the globe and broadcast; beyond,
    Spark splits the cells that many centres hold. A last cell with many points is
    shared by as many tasks as its count asks for. Equal distances are ordered by
    ``point_keys``; with fewer than k points all are listed. Rows without a position
    and centres without a key are left out. Points and counts are written to the
    shared folder once.
    """
    pairs = compared_pairs(points, centers.where(F.col(center_key).isNotNull()), center_key, point_keys, k, levels)
    return _ranked(pairs, center_key, point_keys, k)


def _with_slack(square):
    """A square of a chord, and more than what rounding can add to it."""
    return square * (1 + 1e-7) + 1e-15


def compared_pairs(
    points: DataFrame, centers: DataFrame, center_key: str, point_keys: list[str], k: int, levels: tuple[int, ...] = LEVELS,
    meters: float | None = None,
) -> DataFrame:
    """``center_key, *point_keys, distance`` of the points that can be among the ``k`` nearest, or the ``k`` nearest within ``meters``."""
    position, spot = [F.col("lat"), F.col("lng")], ["__lat", "__lng"]
    placed = points.filter(has_position(*position)).select(*point_keys, *[c.alias(n) for c, n in zip(position, spot, strict=True)])
    p = stored(first_per_key(placed, spot, point_keys, k), "cell-points").withColumn("__at", _on_sphere(*map(F.col, spot)))
    # Rows of one key and position are one centre while cells are judged, or their counts would add up.
    # It has a number, since Spark deals out rows by doubles in one way for windows and in another for repartition.
    spots = ["__center_lat", "__center_lng"]
    c = centers.filter(has_position(*position)).select(center_key, *[c.alias(n) for c, n in zip(position, spots, strict=True)])
    c = c.groupBy(center_key, *spots).agg(F.count("*").alias("__rows"))
    c = stored(c.withColumn("__id", F.monotonically_increasing_id()), "centers")
    counts = stored(_cell_counts(p, levels), "cell-counts")
    tasks = max(1, math.ceil(c.count() / _TASK_CENTERS))
    parents = [f"__p{n[-1]}" for n in _CELLS]
    by_center = Window.partitionBy("__id")
    by_reach = by_center.orderBy("__far").rowsBetween(Window.unboundedPreceding, 0)
    at = _on_sphere(*map(F.col, spots)).alias("__center_at")
    held, before = c.repartition(tasks, "__id").select("__id", at, *[F.lit(0).cast("long").alias(n) for n in parents]), 0
    reach = None if meters is None else F.lit(_with_slack((2 * math.sin(meters / EARTH_METERS / 2)) ** 2))
    for level in levels:
        here = counts.where(F.col("__level") == level).select(
            *_CELLS, "__n", *[F.shiftright(n, level - before).alias(q) for n, q in zip(_CELLS, parents, strict=True)]
        )
        side = 2.0 / (1 << level)
        near, far = F.lit(0.0), F.lit(0.0)
        for n, a in zip(_CELLS, ("x", "y", "z"), strict=True):
            low = F.col(n) * side - 1.0 - F.col(f"__center_at.{a}")
            near = near + F.pow(F.greatest(F.lit(0.0), low, -(low + side)), F.lit(2))
            far = far + F.pow(F.greatest(F.abs(low), F.abs(low + side)), F.lit(2))
        opened = held.select("__id", "__center_at", *parents).join(F.broadcast(here) if level <= _BOUNDED_LEVEL else here, parents)
        judged = opened.select("__id", "__center_at", *_CELLS, "__n", near.alias("__near"), far.alias("__far"))
        if reach is not None:
            judged = judged.where(F.col("__near") <= reach)
        judged = judged.withColumn("__reached", F.sum("__n").over(by_reach))
        bound = F.min(F.when(F.col("__reached") >= k, F.col("__far"))).over(by_center)
        kept = judged.withColumn("__bound", bound).where(F.col("__bound").isNull() | (F.col("__near") <= _with_slack(F.col("__bound"))))
        held = kept.select("__id", "__center_at", "__n", *[F.col(n).alias(q) for n, q in zip(_CELLS, parents, strict=True)])
        before = level
    salts = F.ceil(F.col("__n") / _SALT_ROWS).cast("int")
    last = stored(held.select("__id", *[F.col(q).alias(n) for n, q in zip(_CELLS, parents, strict=True)], salts.alias("__salts")), "held-cells")
    used = last.select(*_CELLS, "__salts").distinct()
    spread = last.join(c, "__id").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    # Both sides are sorted: the files of points and centres look smaller than their rows are in a broadcast.
    near_points = p.select(*point_keys, *spot, *_cell_numbers("__at", levels[-1])).join(used.hint("merge"), _CELLS)
    salted = near_points.withColumn("__salt", F.pmod(F.xxhash64(*point_keys), F.col("__salts")).cast("int")).drop("__salts")
    pairs = salted.join(spread.hint("merge"), [*_CELLS, "__salt"])
    distance = great_circle(*map(F.col, spots), F.col("__lat"), F.col("__lng"), EARTH_METERS)
    pairs = pairs.select(center_key, *point_keys, distance.alias("distance"), "__rows")
    return pairs.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows")))).drop("__rows", "__row")
