"""The tiered adaptive search as table jobs: what was found so far, and what to ask next.

A cell of an area is asked for with the first keywords. If they find as many
places as a source lists at most, and the cell can still be divided, its four
children are asked instead and what it found is dropped; otherwise the cell is
final and the other keywords are asked as well. Cells are named by the integer
codes of the density tree (``quadtree``): a leading 1 and two bits a level, so a
cell's ancestors are its code shifted right.

Which cells count is decided by a prefix join: a cell is visited if all its
ancestors were divided. Ancestors are at most 31 shifts of a code, and the join
is an equi-join on area and code; rows of hits join once, on their own cell.

Tables: ``results`` has area, code, keyword, keyword_ord, tier (1 or 2), page,
pos, place_id; ``searched`` has area, code, tier of what has been asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RESULTS_CAP
from .documents import capped_hits
from .keyed import first_per_key
from .quadtree import path_text

CELL = ["area", "code"]


def depth_of(code: Column) -> Column:
    return ((F.length(F.conv(code.cast("string"), 10, 2)) - 1) / 2).cast("int")


def divided_cells(hits: DataFrame, deepest: int, cap: int = RESULTS_CAP) -> DataFrame:
    """``area, code`` of the cells whose first keywords found ``cap`` places or more, above the deepest level."""
    found = hits.where("tier = 1 AND place_id IS NOT NULL").select(*CELL, "place_id").distinct().groupBy(*CELL).agg(F.count("*").alias("n"))
    return found.where((F.col("n") >= cap) & (F.col("code") < F.lit(4**deepest))).select(*CELL)


def visited_cells(cells: DataFrame, divided: DataFrame) -> DataFrame:
    """The cells (distinct area, code) all of whose ancestors were divided."""
    known = cells.withColumn("depth", depth_of(F.col("code")))
    above = known.where("depth > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("up")).select(
        "area", F.col("code").alias("cell"), "depth", F.expr("shiftright(code, 2 * up)").alias("code")
    )
    held = above.join(divided, CELL).groupBy("area", "cell", "depth").agg(F.count("*").alias("n")).where("n = depth")
    return known.where("depth = 0").select(*CELL).unionByName(held.select("area", F.col("cell").alias("code")))


def adaptive_hits(results: DataFrame, deepest: int, cap: int = RESULTS_CAP, listed: int = 60) -> DataFrame:
    """The results of final cells, as far as a source lists them (``listed`` per cell and keyword)."""
    hits = capped_hits(results.withColumn("cell_id", F.struct(*CELL)), listed).drop("cell_id")
    divided = divided_cells(hits, deepest, cap)
    final = visited_cells(hits.select(*CELL).distinct(), divided).join(divided, CELL, "left_anti")
    return hits.join(final, CELL, "left_semi")


def adaptive_search(results: DataFrame, deepest: int, cap: int = RESULTS_CAP, listed: int = 60) -> DataFrame:
    """Each place once, with the hit that a cell-by-cell search meets first.

    Cells go by depth, area and code; a final cell's other keywords come before its
    first ones, then keyword order, page and place on it.
    """
    hits = adaptive_hits(results, deepest, cap, listed).where("place_id IS NOT NULL")
    depth, path = depth_of(F.col("code")), path_text(F.col("code"))
    order = [depth, F.col("area"), F.col("code"), F.col("tier").desc(), F.col("keyword_ord"), F.col("page"), F.col("pos")]
    return first_per_key(hits, ["place_id"], order).select("place_id", "area", "code", path.alias("path"), "tier", "keyword", "keyword_ord", "page", "pos")


def next_searches(areas: DataFrame, results: DataFrame, searched: DataFrame, deepest: int, cap: int = RESULTS_CAP, listed: int = 60) -> DataFrame:
    """``area, code, tier`` of what to ask next; empty when the search is complete.

    First keywords for the areas and for children of divided cells that were not
    asked yet, other keywords for final cells.
    """
    hits = capped_hits(results.withColumn("cell_id", F.struct(*CELL)), listed).drop("cell_id")
    divided = divided_cells(hits, deepest, cap)
    roots = areas.select("area", F.lit(1).cast("long").alias("code"))
    seen = visited_cells(divided, divided)
    children = seen.select(
        "area", F.col("code").alias("parent"), F.explode(F.array(*map(F.lit, range(4)))).alias("digit")
    ).select("area", (F.col("parent") * 4 + F.col("digit")).alias("code"))
    due = roots.unionByName(children).distinct()
    asked = searched.select(*CELL, "tier").distinct()
    first = due.join(asked.where("tier = 1").select(*CELL), CELL, "left_anti").withColumn("tier", F.lit(1))
    final = due.join(asked.where("tier = 1").select(*CELL), CELL, "left_semi").join(divided, CELL, "left_anti")
    return first.unionByName(final.join(asked.where("tier = 2").select(*CELL), CELL, "left_anti").withColumn("tier", F.lit(2)))
