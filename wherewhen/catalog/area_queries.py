"""Queries about distance, regions, map clusters and density cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import adaptive, directory, mapbins, proximity, quadtree, regions
from ..operators.schedule import active_column
from ..schema import DEFAULT_AREA, NEIGHBORHOODS
from . import derived, schedule_queries
from .schedule_queries import AS_OF, HOME

CENTER = (32.762889, -117.119922)
RADIUS = 4000


def radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within 4 km of a point; those without a position stay."""
    return proximity.within_radius(derived.places(spark, sf_dir), CENTER, RADIUS).select("k", "lat", "lng")


def distance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places with their distance and its label, nearest first."""
    near = proximity.with_distance(derived.places(spark, sf_dir), HOME, radius=geo.EARTH_MILES)
    ordered = proximity.nearest_first(near.withColumn("distance", F.round("distance", 6)), ["k"])
    return ordered.select("k", "distance", geo.distance_label(F.col("distance")).alias("label"))


def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest places of every supplier's spot within 1.2 km."""
    k = F.col("s_suppkey")
    centers = derived.table(spark, sf_dir, "supplier").select(
        k.alias("center"),
        ((k * 7919 % 2400 + 326400) / 10000).alias("lat"), (-(k * 104729 % 2000 + 1170800) / 10000).alias("lng"),
    )
    found = proximity.near_centers(derived.places(spark, sf_dir), centers, "center", 1200.0, ["k"], k=3)
    return found.select("center", "k", "rank", F.round("distance", 4).alias("distance"))


def nearest_k_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest places of every supplier's spot, some in the crowd, some at high latitudes, at the seam or far off."""
    k = F.col("s_suppkey")
    centers = derived.table(spark, sf_dir, "supplier").select(
        k.alias("center"),
        F.when(k % 4 == 0, (k * 7919 % 2400 + 326400) / 10000).when(k % 4 == 1, F.lit(70.5)).when(k % 4 == 2, (k % 90).cast("double")).otherwise(-33.25).alias("lat"),
        F.when(k % 4 == 0, -(k * 104729 % 2000 + 1170800) / 10000).when(k % 4 == 1, F.lit(-117.0) + k / 100).when(k % 4 == 2, F.lit(180.0)).otherwise((k % 360 - 180).cast("double")).alias("lng"),
    )
    found = proximity.nearest_k_any(derived.places(spark, sf_dir), centers, "center", ["k"], 4)
    return found.select("center", "k", "rank", F.round("distance", 3).alias("distance"))


def neighborhood_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.assign_region(derived.places(spark, sf_dir), NEIGHBORHOODS).select("k", "neighborhood")


def neighborhood_table_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes plus one small box per supplier, through the tile join."""
    k = F.col("s_suppkey")
    fixed = regions.boxes_frame(spark, NEIGHBORHOODS).drop("label")
    south, west = (k * 7919 % 2300 + 326400) / 10000, -(k * 104729 % 1900 + 1170900) / 10000
    grown = derived.table(spark, sf_dir, "supplier").select(
        (k + 100).cast("int").alias("ord"), F.concat(F.lit("S"), k.cast("string")).alias("id"),
        south.alias("south"), west.alias("west"), (south + 0.01).alias("north"), (west + 0.01).alias("east"),
    )
    assigned = regions.assign_region_table(
        derived.places(spark, sf_dir).select("k", "lat", "lng"), fixed.unionByName(grown), tile_degrees=0.02
    )
    return assigned.select("k", "neighborhood")


def _with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.assign_region(derived.places(spark, sf_dir), NEIGHBORHOODS)


def neighborhood_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_counts(_with_region(spark, sf_dir), at_least=40)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.coverage(
        _with_region(spark, sf_dir), regions.boxes_frame(spark, NEIGHBORHOODS), at_least=120
    )


def area_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in two named search areas and around one point."""
    boxes = regions.select_areas(presets=["north_park", "utc"]) + regions.select_areas(point=(32.70, -117.10))
    return regions.in_boxes(derived.places(spark, sf_dir), boxes).select("k", "lat", "lng")


def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre, size and quadrants of a box around every supplier's spot."""
    k = F.col("s_suppkey")
    south, west = (k * 7919 % 2300 + 326400) / 10000, -(k * 104729 % 1900 + 1170900) / 10000
    box = F.struct(south.alias("south"), west.alias("west"), (south + 0.05).alias("north"), (west + 0.04).alias("east"))
    frame = derived.table(spark, sf_dir, "supplier").select(k.alias("s"), box.alias("box"))
    return frame.select(
        "s", geo.box_center(F.col("box")).alias("c"), geo.box_size(F.col("box")).alias("z"),
        geo.box_rectangle(F.col("box"))["rectangle"]["high"]["latitude"].alias("high_lat"),
        F.explode(geo.quadrants(F.col("box"), 0.075)).alias("q"),
    ).select(
        "s", F.round("c.lat", 9).alias("lat"), F.round("c.lng", 9).alias("lng"),
        F.round("z.width_miles", 6).alias("width_miles"), F.round("z.height_miles", 6).alias("height_miles"),
        F.round("high_lat", 9).alias("high_lat"), "q.digit",
        *[F.round(f"q.{side}", 9).alias(f"q_{side}") for side in quadtree.SIDES],
    )


def _map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.places(spark, sf_dir).select(
        "k", "lat", "lng", active_column("happy_hour_times", AS_OF).alias("active")
    )


def _clusters(zoom: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = mapbins.cluster_points(_map_points(spark, sf_dir), zoom, "k")
        return found.withColumns({"lat": F.round("lat", 9), "lng": F.round("lng", 9)})

    query.__doc__ = f"Map clusters at zoom {zoom}."
    return query


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapbins.bounds(derived.places(spark, sf_dir))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as found by two keywords: ids repeat."""
    places = derived.places(spark, sf_dir).select("k", "place_id", "lat", "lng")
    return places.withColumn("keyword_ord", F.explode(F.sequence(F.lit(0), (F.col("k") % 2).cast("int"))))


def quadtree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = quadtree.quadtree_cells(_hits(spark, sf_dir), DEFAULT_AREA, key="place_id", order=["keyword_ord", "k"])
    return cells.drop("code").withColumns({side: F.round(side, 9) for side in quadtree.SIDES})


def quadtree_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place under its first final cell: the result of the adaptive search."""
    hits = _hits(spark, sf_dir).filter(F.col("place_id") != "")
    leaves = quadtree.quadtree_cells(hits, DEFAULT_AREA, key="place_id", order=["keyword_ord", "k"])
    members = quadtree.quadtree_members(hits, leaves, DEFAULT_AREA, ["place_id"])
    return members.groupBy("place_id").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n_cells"))


FILTERS = directory.Filters(search="venue 1", neighborhood="hillcrest", has_schedule=True, active_now=True)


def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _with_region(spark, sf_dir).withColumnRenamed("k", "ord")
    return directory.directory_query(places, FILTERS, AS_OF, near=HOME).select(
        "ord", "restaurant_name", F.round("distance", 6).alias("distance")
    )


def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address search without position, by name."""
    places = _with_region(spark, sf_dir).withColumnRenamed("k", "ord")
    wanted = directory.Filters(search="7 STREET", has_schedule=True)
    return directory.directory_query(places, wanted, AS_OF, by_name=True).select("ord", "restaurant_name", "address")


def result_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.result_counters(
        _with_region(spark, sf_dir), directory.Filters(search="venue 1", neighborhood="hillcrest"), AS_OF
    )


def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.summary(derived.places(spark, sf_dir))


def first_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.sample_first(derived.places(spark, sf_dir), "k").select("k", "restaurant_name", "menu_summary")


def fetch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.fetch_totals(derived.places(spark, sf_dir))


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of cell searches, one per line item: cells of four levels, some crowded, some below cells that were never divided."""
    depth, k = F.col("l_linenumber") % 4, F.col("l_orderkey")
    width = F.pow(F.lit(4), depth).cast("long")
    keyword = F.col("l_suppkey") % 8
    return derived.table(spark, sf_dir, "lineitem").select(
        (k % 3).cast("long").alias("area"), (width + (k * k) % 97 % width).alias("code"), F.concat(F.lit("kw"), keyword.cast("string")).alias("keyword"),
        keyword.cast("long").alias("keyword_ord"), F.when(keyword < 3, 1).otherwise(2).alias("tier"), F.floor(F.col("l_partkey") / 20 % 5).cast("long").alias("page"),
        (F.col("l_partkey") % 20).cast("long").alias("pos"), derived.place_key(k * 7 % 20011).alias("place_id"),
    ).distinct()


DEEPEST_CELL, CELL_CAP = 3, 25


def adaptive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places a tiered adaptive search finds, each with its first hit."""
    found = adaptive.adaptive_search(search_results(spark, sf_dir), DEEPEST_CELL, CELL_CAP, listed=80)
    return found.select("place_id", "area", "path", "tier", "keyword")


QUERIES = {
    f.__name__: f
    for f in (
        radius_filter, distance_order, nearest_k, nearest_k_any, adaptive_search, neighborhood_assign, neighborhood_table_assign,
        neighborhood_counts, coverage, area_selection, box_geometry, bounds, quadtree_leaves, quadtree_places,
        search_filter, search_names, result_counters, directory_summary, first_sample, fetch_totals,
    )
} | {f"map_clusters_z{zoom}": _clusters(zoom) for zoom in (11, 13, 15)}

# --- SQL ----------------------------------------------------------------------

BOXES_SQL = "boxes AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{b.id}', '{b.label}', CAST({b.south} AS DOUBLE), CAST({b.west} AS DOUBLE), CAST({b.north} AS DOUBLE), "
    f"CAST({b.east} AS DOUBLE))" for i, b in enumerate(NEIGHBORHOODS)
) + ") v(ord, id, label, south, west, north, east))"
_INSIDE = "p.lat BETWEEN b.south AND b.north AND p.lng BETWEEN b.west AND b.east"
REGION_SQL = f"""
regioned AS (
  SELECT p.*, r.id AS neighborhood FROM places p LEFT JOIN (
    SELECT p.k, min_by(b.id, b.ord) AS id FROM places p JOIN boxes b ON {_INSIDE} GROUP BY p.k) r USING (k)
)"""
_SUPPLIER_SPOT = """
centers AS (
  SELECT s_suppkey AS center, (s_suppkey * 7919 % 2400 + 326400) / 10000 AS lat,
    -(s_suppkey * 104729 % 2000 + 1170800) / 10000 AS lng FROM supplier
)"""
_SUPPLIER_BOX = """
sbox AS (
  SELECT s_suppkey AS s, (s_suppkey * 7919 % 2300 + 326400) / 10000 AS south,
    -(s_suppkey * 104729 % 1900 + 1170900) / 10000 AS west FROM supplier
)"""


def _between_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"(2.0 * {geo.EARTH_METERS} * atan2(sqrt({a}), sqrt(1 - {a})))"


def _cluster_sql(zoom: int) -> str:
    side = 20 * 2.0 ** (13 - zoom)
    scale = 256.0 * 2**zoom
    cells = f"""
cells AS (
  SELECT p.k, lat, lng, a.k IS NOT NULL AS active,
    CAST(floor((lng + 180) / 360 * {scale} / {side}) AS BIGINT) AS cell_x,
    CAST(floor((0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * {scale} / {side}) AS BIGINT) AS cell_y
  FROM places p LEFT JOIN active a USING (k) WHERE lat IS NOT NULL AND lng IS NOT NULL
)"""
    if zoom >= 15:
        select = """SELECT 'single' AS kind, cell_x, cell_y, CAST(1 AS BIGINT) AS n_points, round(lat, 9) AS lat,
            round(lng, 9) AS lng, active AS has_active, k AS point_key FROM cells"""
    else:
        select = """SELECT CASE WHEN count(*) = 1 THEN 'single' ELSE 'cluster' END AS kind, cell_x, cell_y,
            count(*) AS n_points, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng,
            bool_or(active) AS has_active, CASE WHEN count(*) = 1 THEN min(k) END AS point_key
            FROM cells GROUP BY cell_x, cell_y"""
    return derived.with_sql([*schedule_queries.FLEXIBLE, schedule_queries.active_sql(), cells], select)


def quadtree_sql() -> list[str]:
    """Level by level: points under open cells, counts, children of crowded cells."""
    a = DEFAULT_AREA
    parts = [
        """
pts AS (
  SELECT DISTINCT place_id, lat, lng FROM places WHERE place_id <> '' AND lat IS NOT NULL AND lng IS NOT NULL
)""",
        f"""
cell0 AS (
  SELECT '' AS path, CAST({a.south} AS DOUBLE) AS south, CAST({a.west} AS DOUBLE) AS west,
    CAST({a.north} AS DOUBLE) AS north, CAST({a.east} AS DOUBLE) AS east
)""",
    ]
    depth = quadtree.max_depth(a)
    for level in range(depth + 1):
        parts.append(f"""
count{level} AS (
  SELECT b.path, b.south, b.west, b.north, b.east, count(p.place_id) AS n FROM cell{level} b
  LEFT JOIN pts p ON {_INSIDE} GROUP BY ALL
)""")
        if level < depth:
            mid = "(south + north) / 2", "(west + east) / 2"
            over = "(north - south) * 0.075", "(east - west) * 0.075"
            low_lat, high_lat = f"{mid[0]} - {over[0]}", f"{mid[0]} + {over[0]}"
            low_lng, high_lng = f"{mid[1]} - {over[1]}", f"{mid[1]} + {over[1]}"
            kids = [
                ("0", "south", "west", high_lat, high_lng), ("1", "south", low_lng, high_lat, "east"),
                ("2", low_lat, "west", "north", high_lng), ("3", low_lat, low_lng, "north", "east"),
            ]
            parts.append(
                f"cell{level + 1} AS (" + " UNION ALL ".join(
                    f"SELECT path || '{d}' AS path, {s} AS south, {w} AS west, {n} AS north, {e} AS east "
                    f"FROM count{level} WHERE n >= 60 AND (east - west) * 58 > 0.75 AND (north - south) * 69 > 0.75"
                    for d, s, w, n, e in kids
                ) + ")"
            )
    parts.append("leaves AS (" + " UNION ALL ".join(
        f"SELECT * FROM count{level} WHERE NOT (n >= 60 AND (east - west) * 58 > 0.75 "
        f"AND (north - south) * 69 > 0.75)" for level in range(depth + 1)
    ) + ")")
    return parts


_FILTERED = [
    *schedule_queries.FLEXIBLE, schedule_queries.active_sql(), BOXES_SQL, REGION_SQL,
]

ORACLE = {
    "radius_filter": derived.with_sql(
        [derived.PLACES_SQL],
        f"""SELECT k, lat, lng FROM places WHERE lat IS NULL OR lng IS NULL
            OR {_between_sql(str(CENTER[0]), str(CENTER[1]), 'lat', 'lng')} <= {RADIUS}""",
    ),
    "distance_order": derived.with_sql(
        [derived.PLACES_SQL, f"d AS (SELECT k, round({schedule_queries.miles_sql('lat', 'lng')}, 6) AS distance FROM places)"],
        f"SELECT k, distance, {schedule_queries.label_sql('distance')} AS label FROM d",
    ),
    "nearest_k": derived.with_sql(
        [derived.PLACES_SQL, _SUPPLIER_SPOT],
        f"""SELECT center, k, CAST(rn AS INT) AS rank, round(distance, 4) AS distance FROM (
              SELECT *, row_number() OVER (PARTITION BY center ORDER BY distance, k) AS rn FROM (
                SELECT center, p.k, {_between_sql('c.lat', 'c.lng', 'p.lat', 'p.lng')} AS distance
                FROM centers c, places p WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL)
              WHERE distance <= 1200) WHERE rn <= 3""",
    ),
    "nearest_k_any": derived.with_sql(
        [derived.PLACES_SQL, """
spots AS (
  SELECT s_suppkey AS center,
    CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey * 7919 % 2400 + 326400) / 10000 WHEN 1 THEN 70.5 WHEN 2 THEN CAST(s_suppkey % 90 AS DOUBLE)
      ELSE -33.25 END AS lat,
    CASE s_suppkey % 4 WHEN 0 THEN -(s_suppkey * 104729 % 2000 + 1170800) / 10000 WHEN 1 THEN -117.0::DOUBLE + s_suppkey / 100
      WHEN 2 THEN 180.0 ELSE CAST(s_suppkey % 360 - 180 AS DOUBLE) END AS lng
  FROM supplier
)"""],
        f"""SELECT center, k, CAST(rn AS INT) AS rank, round(distance, 3) AS distance FROM (
              SELECT *, row_number() OVER (PARTITION BY center ORDER BY distance, k) AS rn FROM (
                SELECT center, p.k, {_between_sql('c.lat', 'c.lng', 'p.lat', 'p.lng')} AS distance
                FROM spots c, places p WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL)) WHERE rn <= 4""",
    ),
    "adaptive_search": f"""
        WITH r AS (
          SELECT DISTINCT l_orderkey % 3 AS area, l_linenumber % 4 AS depth, l_orderkey * l_orderkey % 97 % CAST(pow(4, l_linenumber % 4) AS BIGINT) AS cell,
            l_suppkey % 8 AS kw, l_partkey // 20 % 5 AS page, l_partkey % 20 AS pos, 'P' || lpad(CAST(l_orderkey * 7 % 20011 AS VARCHAR), 9, '0') AS place_id
          FROM lineitem
        ),
        capped AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area, depth, cell, kw ORDER BY page, pos, place_id) AS rn FROM r WHERE page < 4) WHERE rn <= 80
        ),
        divided AS (
          SELECT area, depth, cell FROM capped WHERE kw < 3 AND depth < {DEEPEST_CELL} GROUP BY area, depth, cell HAVING count(DISTINCT place_id) >= {CELL_CAP}
        ),
        cells AS (SELECT DISTINCT area, depth, cell FROM capped),
        final AS (
          SELECT c.* FROM cells c WHERE NOT EXISTS (SELECT 1 FROM divided d WHERE d.area = c.area AND d.depth = c.depth AND d.cell = c.cell)
            AND (c.depth < 1 OR EXISTS (SELECT 1 FROM divided d WHERE d.area = c.area AND d.depth = 0 AND d.cell = 0))
            AND (c.depth < 2 OR EXISTS (SELECT 1 FROM divided d WHERE d.area = c.area AND d.depth = 1 AND d.cell = c.cell // CAST(pow(4, c.depth - 1) AS BIGINT)))
            AND (c.depth < 3 OR EXISTS (SELECT 1 FROM divided d WHERE d.area = c.area AND d.depth = 2 AND d.cell = c.cell // CAST(pow(4, c.depth - 2) AS BIGINT)))
        ),
        ranked AS (
          SELECT h.*, row_number() OVER (PARTITION BY place_id ORDER BY h.depth, h.area, h.cell, h.kw < 3, h.kw, h.page, h.pos) AS first
          FROM capped h JOIN final f USING (area, depth, cell)
        )
        SELECT place_id, area, array_to_string(list_transform(range(depth), lambda i: (cell // CAST(pow(4, depth - 1 - i) AS BIGINT)) % 4), '') AS path,
          CAST(CASE WHEN kw < 3 THEN 1 ELSE 2 END AS INT) AS tier, 'kw' || kw AS keyword
        FROM ranked WHERE first = 1""",
    "neighborhood_assign": derived.with_sql(
        [derived.PLACES_SQL, BOXES_SQL, REGION_SQL], "SELECT k, neighborhood FROM regioned"
    ),
    "neighborhood_table_assign": derived.with_sql(
        [derived.PLACES_SQL, _SUPPLIER_BOX, BOXES_SQL.replace("boxes AS (", "boxes AS (SELECT ord, id, south, west, north, east FROM (", 1)[:-1]
         + ") UNION ALL SELECT s + 100, 'S' || s, south, west, south + 0.01, west + 0.01 FROM sbox)", REGION_SQL],
        "SELECT k, neighborhood FROM regioned",
    ),
    "neighborhood_counts": derived.with_sql(
        [derived.PLACES_SQL, BOXES_SQL, REGION_SQL],
        """SELECT neighborhood, count(*) AS n_places FROM regioned WHERE neighborhood IS NOT NULL
           GROUP BY 1 HAVING count(*) >= 40""",
    ),
    "coverage": derived.with_sql(
        [derived.PLACES_SQL, BOXES_SQL, REGION_SQL],
        """SELECT ord, id, label, (SELECT count(*) FROM regioned r WHERE r.neighborhood = b.id) >= 120 AS covered
           FROM boxes b""",
    ),
    "area_selection": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k, lat, lng FROM places WHERE (lat BETWEEN 32.745 AND 32.770 AND lng BETWEEN -117.135 AND -117.115)
           OR (lat BETWEEN 32.860 AND 32.880 AND lng BETWEEN -117.240 AND -117.220)
           OR (lat BETWEEN CAST(32.70 AS DOUBLE) - CAST(0.012 AS DOUBLE) AND CAST(32.70 AS DOUBLE) + CAST(0.012 AS DOUBLE)
             AND lng BETWEEN CAST(-117.10 AS DOUBLE) - CAST(0.015 AS DOUBLE)
               AND CAST(-117.10 AS DOUBLE) + CAST(0.015 AS DOUBLE))""",
    ),
    "box_geometry": derived.with_sql(
        [_SUPPLIER_BOX, "b AS (SELECT s, south, west, south + 0.05 AS north, west + 0.04 AS east FROM sbox)",
         "m AS (SELECT *, (south + north) / 2 AS lat, (west + east) / 2 AS lng, (north - south) * 0.075 AS oa, "
         "(east - west) * 0.075 AS oo FROM b)"],
        """SELECT s, round(lat, 9) AS lat, round(lng, 9) AS lng, round((east - west) * 58, 6) AS width_miles,
             round((north - south) * 69, 6) AS height_miles, round(north, 9) AS high_lat, digit,
             round(CASE WHEN digit IN ('0', '1') THEN south ELSE lat - oa END, 9) AS q_south,
             round(CASE WHEN digit IN ('0', '2') THEN west ELSE lng - oo END, 9) AS q_west,
             round(CASE WHEN digit IN ('0', '1') THEN lat + oa ELSE north END, 9) AS q_north,
             round(CASE WHEN digit IN ('0', '2') THEN lng + oo ELSE east END, 9) AS q_east
           FROM m, (VALUES ('0'), ('1'), ('2'), ('3')) v(digit)""",
    ),
    "bounds": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM places
           WHERE lat IS NOT NULL AND lng IS NOT NULL""",
    ),
    "quadtree_leaves": derived.with_sql(
        [derived.PLACES_SQL, *quadtree_sql()],
        """SELECT path, CAST(length(path) AS INT) AS depth, round(south, 9) AS south, round(west, 9) AS west,
             round(north, 9) AS north, round(east, 9) AS east, n AS n_points FROM leaves""",
    ),
    "quadtree_places": derived.with_sql(
        [derived.PLACES_SQL, *quadtree_sql()],
        f"""SELECT p.place_id, min(b.path) AS path, count(*) AS n_cells FROM pts p JOIN leaves b ON {_INSIDE}
            GROUP BY p.place_id""",
    ),
    "search_filter": derived.with_sql(
        _FILTERED,
        f"""SELECT k AS ord, restaurant_name, round({schedule_queries.miles_sql('lat', 'lng')}, 6) AS distance
            FROM regioned JOIN active USING (k)
            WHERE neighborhood = 'hillcrest' AND (contains(lower(restaurant_name), 'venue 1')
              OR contains(lower(address), 'venue 1'))""",
    ),
    "search_names": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k AS ord, restaurant_name, address FROM places WHERE trim(happy_hour_times) <> ''
           AND (contains(lower(address), '7 street') OR contains(lower(restaurant_name), '7 street'))""",
    ),
    "result_counters": derived.with_sql(
        _FILTERED + ["shown AS (SELECT k FROM regioned WHERE neighborhood = 'hillcrest' AND restaurant_name ILIKE '%venue 1%')"],
        """SELECT (SELECT count(*) FROM shown) AS shown,
             (SELECT count(*) FROM places WHERE trim(happy_hour_times) <> '') AS with_schedule,
             (SELECT count(*) FROM shown JOIN active USING (k)) AS active""",
    ),
    "directory_summary": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT count(*) AS total, count(*) FILTER (WHERE happy_hour_times <> '') AS with_schedule,
             round(count(*) FILTER (WHERE happy_hour_times <> '') * 100.0 / count(*), 1) AS schedule_percent,
             count(*) FILTER (WHERE menu_summary <> '') AS with_menu,
             round(count(*) FILTER (WHERE menu_summary <> '') * 100.0 / count(*), 1) AS menu_percent FROM places""",
    ),
    "first_sample": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k, restaurant_name, menu_summary FROM (SELECT * FROM places ORDER BY k LIMIT 5)
           WHERE menu_summary <> ''""",
    ),
    "fetch_totals": derived.with_sql(
        [derived.PLACES_SQL],
        "SELECT count(*) AS total, count(*) FILTER (WHERE happy_hour_times <> '') AS with_schedule FROM places",
    ),
} | {f"map_clusters_z{zoom}": _cluster_sql(zoom) for zoom in (11, 13, 15)}
