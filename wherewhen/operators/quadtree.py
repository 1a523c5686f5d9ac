"""Adaptive density cells over points.

A cell that holds at least ``cap`` points and is large enough splits in four
overlapping children. A child lies inside its parent, so a child over the cap
has only ancestors over the cap: whether a cell is split depends on its own
count, and a leaf is a cell under the cap whose parent is split. All levels can
therefore be counted in one pass. Each point is listed under every cell that
contains it (about 1.3 times more per level, because children overlap) and the
counts, at most ``4^levels`` of them, combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Box, has_position
from ..schema import CELL_OVERLAP, MIN_CELL_MILES, RESULTS_CAP
from ..session import ensure_checkpoint_dir, stored
from .keyed import dedup_first, splittable_join

# Levels counted in one pass: 1 + 4 + ... + 4^5 cells at most per open cell.
LEVELS_PER_PASS = 5
SIDES = ["south", "west", "north", "east"]
# Leaves that are sent to every task, of some 100 bytes each.
_BROADCAST_LEAVES = 100_000


# A code is a leading 1 and two bits a level, in a long.
DEEPEST = 31


def max_depth(box: Box, min_miles: float = MIN_CELL_MILES, overlap: float = CELL_OVERLAP) -> int:
    """Deepest level a cell can have: cells split while both sides exceed the minimum."""
    if min_miles <= 0 or not 0 <= overlap < 0.5:
        raise ValueError("cells need a positive minimum side and an overlap below one half")
    width, height, depth = box.width_miles, box.height_miles, 0
    while width > min_miles and height > min_miles:
        width, height, depth = width * (0.5 + overlap), height * (0.5 + overlap), depth + 1
    if depth > DEEPEST:
        raise ValueError(f"cells of {min_miles} miles need {depth} levels; a cell's code holds {DEEPEST}")
    return depth


def path_text(code: Column) -> Column:
    """Digits of a cell code: 0 south-west, 1 south-east, 2 north-west, 3 north-east."""
    return F.substring(F.conv(code.cast("string"), 10, 4), 2, 64)


def _first_code(depth: int) -> int:
    """Codes are a leading 1 and one base-4 digit per level."""
    return 4**depth


def _descend(frame: DataFrame, digit: Column, overlap: float) -> DataFrame:
    """Replace each cell by its child ``digit``; a negative digit stays where it is."""
    south, west, north, east = (F.col(side) for side in SIDES)
    mid_lat, mid_lng = (south + north) / 2, (west + east) / 2
    over_lat, over_lng = (north - south) * overlap, (east - west) * overlap
    moved = frame.withColumn("digit", F.explode(digit))
    chosen = F.col("digit")
    return moved.withColumns({
        "code": F.when(chosen < 0, F.col("code")).otherwise(F.col("code") * 4 + chosen),
        "open": chosen >= 0,
        "south": F.when(chosen >= 2, mid_lat - over_lat).otherwise(south),
        "north": F.when(chosen.isin(0, 1), mid_lat + over_lat).otherwise(north),
        "west": F.when(chosen.isin(1, 3), mid_lng - over_lng).otherwise(west),
        "east": F.when(chosen.isin(0, 2), mid_lng + over_lng).otherwise(east),
    }).drop("digit")


def _digits(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _listed(located: DataFrame, levels: int, overlap: float) -> DataFrame:
    """Every point under its cell and each cell below it that contains the point.

    One chain of explodes: at each level a row both stays (and is done) and
    moves on into the children that contain it.
    """
    frame = located.withColumn("open", F.lit(True))
    for _ in range(levels):
        frame = _descend(
            frame, F.when(F.col("open"), _digits(-1, 0, 1, 2, 3)).otherwise(_digits(-1)), overlap
        ).filter(
            F.col("lat").between(F.col("south"), F.col("north"))
            & F.col("lng").between(F.col("west"), F.col("east"))
        )
    return frame.drop("open")


def _at_root(frame: DataFrame, box: Box) -> DataFrame:
    return frame.withColumns({
        "code": F.lit(1).cast("long"), "south": F.lit(box.south), "west": F.lit(box.west),
        "north": F.lit(box.north), "east": F.lit(box.east),
    })


def _located(points: DataFrame, box: Box) -> DataFrame:
    return _at_root(
        points.filter(
            has_position(F.col("lat"), F.col("lng")) & box.contains(F.col("lat"), F.col("lng"))
        ),
        box,
    )


def quadtree_cells(
    points: DataFrame, box: Box, key: str | None = None, order: list[str] | None = None, cap: int = RESULTS_CAP,
    min_miles: float = MIN_CELL_MILES, overlap: float = CELL_OVERLAP, levels_per_pass: int = LEVELS_PER_PASS,
) -> DataFrame:
    """All final cells: ``code, path, depth, south, west, north, east, n_points``.

    With ``key``, repeated ids count once. Cells without points appear as well,
    as long as their parent was split.
    """
    deepest = max_depth(box, min_miles, overlap)
    splits = (F.col("n") >= cap) & (F.col("code") < _first_code(deepest))
    rows = points if key is None else dedup_first(points, key, order or [key])
    located = _located(rows.select("lat", "lng"), box)
    counts, done = None, 0
    while True:
        levels = min(levels_per_pass, deepest - done)
        listed = _listed(located, levels, overlap)
        fresh = listed if done == 0 else listed.filter(F.col("code") >= _first_code(done + 1))
        counted = fresh.groupBy("code").agg(
            F.count("*").alias("n"), *[F.max(side).alias(side) for side in SIDES]
        )
        counts = counted if counts is None else counts.unionByName(counted)
        done += levels
        if done == deepest:
            break
        # Deeper levels follow: only points in cells that were split go on. The
        # counts are stored, so that the next pass does not repeat this one.
        ensure_checkpoint_dir(points.sparkSession)
        counts = counts.checkpoint()
        bottom = F.col("code") >= _first_code(done)
        crowded = counts.filter(splits & bottom).select("code")
        located = listed.filter(bottom).join(crowded, "code", "left_semi")
    # A cell is final when its parent was split and it is not. Each counted cell
    # states its own count and, if split, that its children exist; grouping the
    # statements needs the counts once, where a join would compute them twice.
    stated = _descend(
        counts, F.when(splits, _digits(-1, 0, 1, 2, 3)).otherwise(_digits(-1)), overlap
    ).select("code", *SIDES, F.when(~F.col("open"), F.col("n")).alias("n"), F.col("open").alias("born"))
    root = _at_root(points.sparkSession.range(1), box).select(
        "code", *SIDES, F.lit(0).cast("long").alias("n"), F.lit(True).alias("born")
    )
    cells = stated.unionByName(root).groupBy("code").agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("born").alias("born"),
        *[F.max(side).alias(side) for side in SIDES],
    )
    path = path_text(F.col("code"))
    return cells.filter(F.col("born") & ~splits).select(
        "code", path.alias("path"), F.length(path).alias("depth"), *SIDES, F.col("n").alias("n_points")
    )


def quadtree_members(
    points: DataFrame, leaves: DataFrame, box: Box, keys: list[str], overlap: float = CELL_OVERLAP,
    min_miles: float = MIN_CELL_MILES,
) -> DataFrame:
    """Point and leaf pairs; a point in the overlap of leaves appears under each.

    Points are listed under every cell above and at their leaves, many times the
    rows Spark expects of the points' file, so it must not choose that side for a
    broadcast. The leaves are written to the shared folder and counted: few are
    broadcast, so that listed points meet them where they are; for more, both sides
    are sorted by cell.
    """
    located = _located(points.select(*list(dict.fromkeys([*keys, "lat", "lng"]))), box)
    listed = _listed(located, max_depth(box, min_miles, overlap), overlap)
    kept = stored(leaves.select("code", "path"), "leaves")
    if kept.count() <= _BROADCAST_LEAVES:
        return listed.select(*keys, "code").join(F.broadcast(kept), "code")
    return splittable_join(listed.select(*keys, "code"), kept.hint("merge"), "code", "inner")
