"""Queries about lookups, merges, dedup and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled
from ..operators import documents, incremental, keyed, merge
from . import derived

NOW = "2024-03-10 12:00:00"
SNAPSHOT_NOW = "2024-02-10 12:00:00"


def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = keyed.apply_overrides(
        derived.places(spark, sf_dir), derived.overrides(spark, sf_dir), seeds=["k"]
    )
    return joined.select("k", "happy_hour_times", "source", "freshness_date")


def menu_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = keyed.attach_menu(derived.places(spark, sf_dir), derived.menu(spark, sf_dir), seeds=["k"])
    return joined.select("k", *keyed.MENU_COLUMNS)


def place_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep link: the places the events point at, by id."""
    asked = derived.table(spark, sf_dir, "events").select(
        derived.place_key(F.col("user_id") * 10 + 1).alias("place_id")
    ).distinct()
    return derived.places(spark, sf_dir).filter(filled(F.col("place_id"))).join(
        asked, "place_id", "left_semi"
    ).select("k", "place_id", "restaurant_name")


def key_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = derived.places(spark, sf_dir).withColumnRenamed("k", "ord")
    filled_in = keyed.key_backfill(derived.menu(spark, sf_dir), places, seeds=["ord"])
    return filled_in.select("ord", "place_id", "restaurant_name", "match_status", "menu_url")


def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = derived.places(spark, sf_dir).withColumnRenamed("k", "ord")
    return keyed.ambiguous_names(places, "ord")


def existing_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A directory and a refresh that overlap, from the same places.

    The refresh repeats some ids, blanks some columns and moves some ids to
    names that exist without id.
    """
    k = F.col("k")
    base = derived.places(spark, sf_dir).select(
        k, k.alias("ord"), "restaurant_name", "address", "phone_number", "happy_hour_times",
        F.col("rating"), "freshness_date", "place_id", "menu_summary",
        F.when(k % 3 != 0, (k % 9).cast("double")).alias("cheapest_drink_price"),
    )
    existing = base.filter(k % 10 < 7).withColumns({
        "place_id": F.when(k % 13 == 0, "").otherwise(F.col("place_id")),
    }).drop("k")
    new = base.filter(k % 10 > 3).withColumns({
        "place_id": F.when(k % 29 == 0, derived.place_key(k - 1)).otherwise(F.col("place_id")),
        "restaurant_name": F.when(k % 17 == 0, F.concat(F.lit("New "), F.col("restaurant_name"))).otherwise(F.col("restaurant_name")),
        "phone_number": F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "").otherwise(F.col("phone_number")),
        "happy_hour_times": F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Friday: "), (k % 12).cast("string"), F.lit(" PM"))),
        "cheapest_drink_price": F.when(k % 5 == 0, 0.0).when(k % 5 == 1, F.lit(None)).otherwise((k % 7).cast("double")),
        "freshness_date": F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise("2026-05-01"),
        "rating": F.when(k % 8 == 0, F.lit(None).cast("string")).otherwise("5.0"),
    }).drop("k")
    return existing, new


def _merged(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return merge.survivorship_merge(*existing_new(spark, sf_dir), **options)


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


def merge_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, compat=True)


def merge_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, prune=True).select("place_id", "restaurant_name", "action", "section", "position")


def merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_metrics(*existing_new(spark, sf_dir), prune=True)


def restore_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, new = existing_new(spark, sf_dir)
    skipped = incremental.fresh_ids(existing, NOW, 30)
    return merge.restore_skipped(new, existing, skipped).select("place_id", "restaurant_name", "rating")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged search hits from line items: cell, keyword, page, position, place."""
    line = F.col("l_linenumber")
    return derived.table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("cell_id"), (line % 5).cast("int").alias("keyword_ord"),
        F.floor(F.col("l_orderkey") / 20).alias("page"), (F.col("l_orderkey") % 20).alias("pos"),
        F.col("l_partkey").alias("tie"), line.alias("line"),
        F.when(F.col("l_partkey") % 50 == 0, "").otherwise(derived.place_key(F.col("l_partkey"))).alias("place_id"),
    )


_HIT_ORDER = ["keyword_ord", "page", "pos", "tie", "line", "cell_id"]


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.dedup_first(search_results(spark, sf_dir), "place_id", _HIT_ORDER).select(
        "place_id", *_HIT_ORDER
    )


def search_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 60 hits per cell and keyword, in pages of 20, as the source pages them."""
    hits = search_results(spark, sf_dir).select(
        "cell_id", F.col("keyword_ord").alias("keyword"), (F.col("line") % 6).alias("page"), "pos", "place_id"
    )
    return documents.capped_hits(hits)


def union_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-filling keywords first, then the main ones; the first id wins."""
    hits = search_results(spark, sf_dir)
    more, main = hits.filter(F.col("keyword_ord") >= 3), hits.filter(F.col("keyword_ord") < 3)
    return keyed.union_tiers(more, main, key="place_id", order=_HIT_ORDER).select("place_id", "tier", *_HIT_ORDER)


def menu_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The menu table with itself under shifted ids put over it."""
    menu = derived.menu(spark, sf_dir)
    k = F.col("ord")
    shifted = F.when(k % 4 == 0, "").otherwise(derived.place_key(k * 7 % 3000))
    return keyed.upsert(menu, menu.withColumns({"place_id": shifted, "menu_url": F.lit("/new")}))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("ts").alias("cached_at"),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.col("props"), F.lit("}}"))).otherwise(F.col("props")).alias("payload"),
    )


def ttl_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key against the valid snapshots."""
    valid = incremental.ttl_latest(snapshots(spark, sf_dir), SNAPSHOT_NOW, ttl_days=11.6)
    keys = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return incremental.batch_lookup(keys, valid).select(
        "key", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached_at"), "payload"
    )


def stale_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = derived.places(spark, sf_dir)
    return incremental.skip_fresh(
        places.select("k", "place_id", "freshness_date"), incremental.fresh_ids(places, NOW, 30)
    )


def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.places(spark, sf_dir).select(
        "k", incremental.request_key(F.struct(F.col("restaurant_name").alias("name"), F.col("place_id"))).alias("key")
    )


def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = derived.places(spark, sf_dir)
    return incremental.pending_schedules(places).select("k", F.lit("schedule").alias("step")).unionByName(
        incremental.pending_menus(places).select("k", F.lit("menu").alias("step"))
    )


def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = derived.places(spark, sf_dir)
    after = keyed.attach_menu(before, derived.menu(spark, sf_dir), seeds=["k"])
    return incremental.success_rate(before, after, "k", "menu_summary")


QUERIES = {
    f.__name__: f
    for f in (
        override_join, menu_join, place_by_id, key_backfill, ambiguous_names, merge_upsert, merge_compat,
        merge_prune, merge_metrics, restore_skipped, dedup_first, search_cap, union_tiers, menu_upsert,
        ttl_lookup, stale_skip, request_keys, pending_work, fill_rate,
    )
}

# --- SQL ----------------------------------------------------------------------

OVERRIDE_SQL = """
ov_id AS (
  SELECT trim(place_id) AS pid, max_by(ord, ord) AS ord FROM overrides
  WHERE restaurant_name <> '' AND trim(place_id) <> '' GROUP BY 1
),
ov_name AS (SELECT restaurant_name AS nm, max(ord) AS ord FROM overrides WHERE restaurant_name <> '' GROUP BY 1),
ov_hit AS (
  SELECT p.k, coalesce(i.ord, n.ord) AS ord FROM places p
  LEFT JOIN ov_id i ON i.pid = trim(p.place_id) AND trim(p.place_id) <> ''
  LEFT JOIN ov_name n ON n.nm = p.restaurant_name
)"""
MENU_HIT_SQL = """
menu_hit AS (
  SELECT p.k, coalesce(i.ord, n.ord) AS ord FROM places p
  LEFT JOIN (SELECT trim(place_id) AS pid, max(ord) AS ord FROM menu
             WHERE restaurant_name <> '' AND trim(place_id) <> '' GROUP BY 1) i
    ON i.pid = trim(p.place_id) AND trim(p.place_id) <> ''
  LEFT JOIN (SELECT restaurant_name AS nm, max(ord) AS ord FROM menu WHERE restaurant_name <> '' GROUP BY 1) n
    ON n.nm = p.restaurant_name
)"""

_PAIR_SQL = f"""
base AS (
  SELECT k, k AS ord, restaurant_name, address, phone_number, happy_hour_times, rating, freshness_date, place_id,
    menu_summary, CASE WHEN k % 3 <> 0 THEN CAST(k % 9 AS DOUBLE) END AS cheapest_drink_price
  FROM places
),
existing AS (
  SELECT * REPLACE (CASE WHEN k % 13 = 0 THEN '' ELSE place_id END AS place_id) FROM base WHERE k % 10 < 7
),
fresh AS (
  SELECT * REPLACE (
    CASE WHEN k % 29 = 0 THEN 'P' || lpad(CAST(k - 1 AS VARCHAR), 9, '0') ELSE place_id END AS place_id,
    CASE WHEN k % 17 = 0 THEN 'New ' || restaurant_name ELSE restaurant_name END AS restaurant_name,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '' ELSE phone_number END AS phone_number,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'Friday: ' || (k % 12) || ' PM' END AS happy_hour_times,
    CASE WHEN k % 5 = 0 THEN 0.0 WHEN k % 5 = 1 THEN NULL ELSE CAST(k % 7 AS DOUBLE) END AS cheapest_drink_price,
    CASE WHEN k % 6 = 0 THEN NULL ELSE '2026-05-01' END AS freshness_date,
    CASE WHEN k % 8 = 0 THEN NULL ELSE '5.0' END AS rating)
  FROM base WHERE k % 10 > 3
)"""

_ROUTE_COMPAT = """
routed AS (
  SELECT f.*, CASE
      WHEN f.place_id <> '' AND (f.place_id IN (SELECT place_id FROM existing WHERE place_id <> '')
        OR f.ord >= a.first_append) THEN 'id:' || f.place_id
      WHEN f.restaurant_name IN (SELECT restaurant_name FROM existing WHERE place_id = '')
        THEN 'name:' || f.restaurant_name
      WHEN f.place_id <> '' THEN 'id:' || f.place_id
      ELSE 'row:' || f.ord END AS target
  FROM fresh f LEFT JOIN (
    SELECT place_id, min(ord) AS first_append FROM fresh
    WHERE place_id <> '' AND restaurant_name NOT IN (SELECT restaurant_name FROM existing WHERE place_id = '')
    GROUP BY place_id) a ON a.place_id = f.place_id
)"""
_ROUTE = """
claims AS (
  SELECT restaurant_name, min_by(place_id, ord) AS place_id, min(ord) AS ord FROM fresh
  WHERE place_id <> '' AND place_id NOT IN (SELECT place_id FROM existing WHERE place_id <> '')
    AND restaurant_name IN (SELECT restaurant_name FROM existing WHERE place_id = '')
  GROUP BY restaurant_name
),
homes AS (SELECT place_id, min_by(restaurant_name, ord) AS home FROM claims GROUP BY place_id),
routed AS (
  SELECT f.*, CASE
      WHEN f.place_id IN (SELECT place_id FROM existing WHERE place_id <> '') THEN 'id:' || f.place_id
      WHEN f.place_id <> '' AND h.home IS NOT NULL THEN 'name:' || h.home
      WHEN f.place_id = '' AND f.restaurant_name IN (SELECT restaurant_name FROM existing WHERE place_id = '')
        THEN 'name:' || f.restaurant_name
      WHEN f.place_id <> '' THEN 'id:' || f.place_id
      ELSE 'row:' || f.ord END AS target
  FROM fresh f LEFT JOIN homes h ON h.place_id = f.place_id
)"""


def _fold(compat: bool) -> str:
    def last(column: str, condition: str) -> str:
        return (
            f"coalesce(last({column} ORDER BY side, ord) FILTER (WHERE {condition}), "
            f"first({column} ORDER BY side, ord)) AS {column}"
        )

    plain = ", ".join(last(c, f"{c} IS NOT NULL") for c in ("restaurant_name", "address", "phone_number", "rating"))
    texts = ", ".join(last(c, f"{c} <> ''") for c in ("happy_hour_times", "menu_summary"))
    return f"""
both_sides AS (
  SELECT * EXCLUDE (k, rn), 0 AS side FROM (
    SELECT *, CASE WHEN place_id <> '' THEN 'id:' || place_id ELSE 'name:' || restaurant_name END AS target,
      min(ord) OVER (PARTITION BY target) AS pos, row_number() OVER (PARTITION BY target ORDER BY ord DESC) AS rn
    FROM existing) WHERE rn = 1
  UNION ALL BY NAME SELECT * EXCLUDE (k), NULL AS pos, 1 AS side FROM routed
),
folded AS (
  SELECT target, {plain}, {texts}, {last('cheapest_drink_price', 'cheapest_drink_price <> 0')},
    last(freshness_date ORDER BY side, ord) AS freshness_date,
    {"last(place_id ORDER BY side, ord) AS place_id" if compat else last('place_id', "place_id <> ''")},
    min(side) AS first_side, sum(side) AS n_new, coalesce(min(pos), min(ord)) AS position
  FROM both_sides GROUP BY target
),
merged AS (
  SELECT restaurant_name, address, phone_number, happy_hour_times, rating, freshness_date, place_id, menu_summary,
    cheapest_drink_price,
    CASE WHEN first_side = 1 THEN 'added' WHEN n_new > 0 THEN 'updated' ELSE 'kept' END AS action,
    starts_with(target, 'name:') AND place_id <> '' AS upgraded,
    CAST(n_new - first_side AS BIGINT) AS n_updates, CAST(starts_with(target, 'name:') AS INT) AS section,
    first_side AS appended, position
  FROM folded
)"""


_MERGE = [derived.PLACES_SQL, _PAIR_SQL, _ROUTE, _fold(False)]
_HITS_SQL = """
hits AS (
  SELECT l_suppkey % 10 AS cell_id, CAST(l_linenumber % 5 AS INT) AS keyword_ord, l_orderkey // 20 AS page,
    l_orderkey % 20 AS pos, l_partkey AS tie, l_linenumber AS line,
    CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'P' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS place_id
  FROM lineitem
)"""
_FRESH = "TRY_CAST(freshness_date AS DATE) >= TIMESTAMP '2024-03-10 12:00:00' - INTERVAL 30 DAY"

ORACLE = {
    "override_join": derived.with_sql(
        [derived.PLACES_SQL, derived.OVERRIDES_SQL, OVERRIDE_SQL],
        """SELECT p.k, CASE WHEN o.happy_hour_times <> '' THEN o.happy_hour_times ELSE p.happy_hour_times END
             AS happy_hour_times,
             CASE WHEN o.happy_hour_times <> '' THEN CASE WHEN o.source <> '' THEN o.source ELSE 'Manual Override' END
               ELSE p.source END AS source,
             CASE WHEN o.happy_hour_times <> '' AND o.freshness_date <> '' THEN o.freshness_date
               ELSE p.freshness_date END AS freshness_date
           FROM places p JOIN ov_hit h USING (k) LEFT JOIN overrides o ON o.ord = h.ord""",
    ),
    "menu_join": derived.with_sql(
        [derived.PLACES_SQL, derived.MENU_SQL, MENU_HIT_SQL],
        """SELECT p.k, nullif(m.cheapest_drink, '') AS cheapest_drink,
             TRY_CAST(nullif(m.cheapest_drink_price, '') AS DOUBLE) AS cheapest_drink_price,
             nullif(m.cheapest_food, '') AS cheapest_food,
             TRY_CAST(nullif(m.cheapest_food_price, '') AS DOUBLE) AS cheapest_food_price,
             CASE WHEN h.ord IS NOT NULL THEN nullif(m.menu_summary, '') ELSE p.menu_summary END AS menu_summary,
             nullif(m.menu_url, '') AS menu_url
           FROM places p JOIN menu_hit h USING (k) LEFT JOIN menu m ON m.ord = h.ord""",
    ),
    "place_by_id": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k, place_id, restaurant_name FROM places WHERE place_id IN (
             SELECT 'P' || lpad(CAST(user_id * 10 + 1 AS VARCHAR), 9, '0') FROM events)""",
    ),
    "key_backfill": derived.with_sql(
        [derived.PLACES_SQL, derived.MENU_SQL],
        """SELECT m.ord, CASE WHEN m.place_id <> '' THEN m.place_id ELSE coalesce(i.first_id, '') END AS place_id,
             m.restaurant_name, CASE WHEN m.place_id <> '' THEN 'kept' WHEN i.n IS NULL THEN 'none'
               WHEN i.n > 1 THEN 'ambiguous' ELSE 'unique' END AS match_status, m.menu_url
           FROM menu m LEFT JOIN (
             SELECT restaurant_name, min_by(place_id, k) AS first_id, count(*) AS n FROM places
             WHERE place_id <> '' GROUP BY 1) i USING (restaurant_name)""",
    ),
    "ambiguous_names": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT restaurant_name AS name, place_id, k AS ord, n_ids FROM (
             SELECT *, count(*) OVER (PARTITION BY restaurant_name) AS n_ids FROM places WHERE place_id <> '')
           WHERE n_ids > 1""",
    ),
    "merge_upsert": derived.with_sql(_MERGE, "SELECT * FROM merged"),
    "merge_compat": derived.with_sql(
        [derived.PLACES_SQL, _PAIR_SQL, _ROUTE_COMPAT, _fold(True)], "SELECT * FROM merged"
    ),
    "merge_prune": derived.with_sql(
        _MERGE,
        """SELECT place_id, restaurant_name, action, section, position FROM merged
           WHERE section = 1 OR place_id = '' OR place_id IN (SELECT place_id FROM fresh)""",
    ),
    "merge_metrics": derived.with_sql(
        _MERGE,
        """SELECT CAST(sum(n_updates) AS BIGINT) AS updated, count(*) FILTER (WHERE action = 'added') AS added,
             count(*) FILTER (WHERE upgraded) AS upgraded,
             count(*) FILTER (WHERE section = 0 AND place_id <> '' AND place_id NOT IN (SELECT place_id FROM fresh))
               AS pruned,
             count(*) FILTER (WHERE NOT (section = 0 AND place_id <> '' AND place_id NOT IN
               (SELECT place_id FROM fresh))) AS total
           FROM merged""",
    ),
    "restore_skipped": derived.with_sql(
        [derived.PLACES_SQL, _PAIR_SQL],
        f"""SELECT place_id, restaurant_name, rating FROM fresh UNION ALL
            SELECT place_id, restaurant_name, rating FROM existing WHERE place_id <> ''
              AND place_id IN (SELECT place_id FROM existing WHERE {_FRESH})
              AND place_id NOT IN (SELECT place_id FROM fresh)""",
    ),
    "dedup_first": derived.with_sql(
        [_HITS_SQL],
        """SELECT place_id, keyword_ord, page, pos, tie, line, cell_id FROM hits WHERE place_id <> ''
           QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY keyword_ord, page, pos, tie, line, cell_id) = 1""",
    ),
    "search_cap": derived.with_sql(
        [_HITS_SQL],
        """SELECT cell_id, keyword_ord AS keyword, line % 6 AS page, pos, place_id FROM hits WHERE line % 6 < 3
           QUALIFY row_number() OVER (PARTITION BY cell_id, keyword_ord ORDER BY line % 6, pos, place_id) <= 60""",
    ),
    "union_tiers": derived.with_sql(
        [_HITS_SQL],
        """SELECT place_id, CASE WHEN keyword_ord >= 3 THEN 0 ELSE 1 END AS tier, keyword_ord, page, pos, tie, line,
             cell_id FROM hits WHERE place_id <> ''
           QUALIFY row_number() OVER (PARTITION BY place_id
             ORDER BY keyword_ord < 3, keyword_ord, page, pos, tie, line, cell_id) = 1""",
    ),
    "menu_upsert": derived.with_sql(
        [derived.MENU_SQL],
        """SELECT * EXCLUDE (side) FROM (
             SELECT *, 0 AS side FROM menu UNION ALL
             SELECT * REPLACE (CASE WHEN ord % 4 = 0 THEN '' ELSE 'P' || lpad(CAST(ord * 7 % 3000 AS VARCHAR), 9, '0') END
               AS place_id, '/new' AS menu_url), 1 FROM menu)
           QUALIFY row_number() OVER (PARTITION BY CASE WHEN trim(place_id) <> '' THEN place_id ELSE restaurant_name END
             ORDER BY side DESC, ord DESC) = 1""",
    ),
    "ttl_lookup": """
        SELECT c_custkey AS key, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS cached_at, payload FROM customer LEFT JOIN (
          SELECT user_id AS key, ts AS cached_at,
            CASE WHEN event_id % 11 = 0 THEN props || '}}' ELSE props END AS payload FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) s
        ON s.key = c_custkey AND s.cached_at >= TIMESTAMP '2024-02-10 12:00:00' - to_seconds(1002240)
          AND json_valid(payload)""",
    "stale_skip": derived.with_sql(
        [derived.PLACES_SQL],
        f"""SELECT k, place_id, freshness_date FROM places WHERE place_id = '' OR place_id NOT IN (
              SELECT place_id FROM places WHERE place_id <> '' AND {_FRESH})""",
    ),
    "request_keys": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k, left(md5('{"name":"' || restaurant_name || '","place_id":"' || place_id || '"}'), 16) AS key
           FROM places""",
    ),
    "pending_work": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k, 'schedule' AS step FROM places WHERE happy_hour_times = '' UNION ALL
           SELECT k, 'menu' FROM places WHERE website_url <> '' AND menu_summary = ''""",
    ),
    "fill_rate": derived.with_sql(
        [derived.PLACES_SQL, derived.MENU_SQL, MENU_HIT_SQL],
        """SELECT count(*) AS selected, count(m.ord) FILTER (WHERE m.menu_summary <> '') AS succeeded,
             round(count(m.ord) FILTER (WHERE m.menu_summary <> '') * 100.0 / count(*), 1) AS percent
           FROM places p JOIN menu_hit h USING (k) LEFT JOIN menu m ON m.ord = h.ord WHERE p.menu_summary = ''""",
    ),
}
