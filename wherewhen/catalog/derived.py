"""Directory tables computed from the TPC-H-like tables.

Every order becomes a place, every part a menu row, every line item a menu
item. The formulas are integer arithmetic on the key ``k``, so that another
engine computes identical values; ``PLACES_SQL`` and its neighbours say the
same in SQL. Nothing is inlined but short lists that the key picks from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NARROW, THIN, HAIR, ZERO = "\u202f", "\u2009", "\u200a", "\u200b"
EN = "\u2013"

# Schedule texts a place can have; {a} and {b} are an hour 1-5 and 6-9.
SCHEDULES = [
    "Sunday: {a}:00 PM - {b}:00 PM",
    "Monday: {a}:00 PM - {b}:00 PM | Sunday: {a} - {b} PM",
    "",
    "Sunday: Closed | Monday: {a}:00 PM - {b}:00 PM | Friday: {a}:30 PM - {b}:30 PM",
    "Monday: {a} - {b} pmTuesday: {a} - {b} pmSunday: {a} - {b} pm",
    "Sunday: 10:00 PM - 12:00 AM | Saturday: 9:00 PM - 1:00 AM",
    "Sunday: {a}:00 PM - {b}:00 PM, 9:00 PM - 11:00 PM | Tuesday: {a}pm-{b}pm",
    f"Sunday:{NARROW}{{a}}:00{NARROW}PM{THIN}{EN}{THIN}{{b}}:00{HAIR}PM",
    "Sunday: {a}pm-{b}pm | Wednesday: 15:00 - 18:00",
    "sunday: {a}:00 PM - {b}:00 PM | MONDAY: Closed",
    "Sunday: 15:{a}0 - 18:00 | Thursday: {a} - {b} p.m.",
    "Sunday: 4:00 PM - Close | Monday: 4:00 PM - Close",
    "Sunday: Closed | Monday: Closed",
    "Tuesday: {a}:00 - {b}:00 PM, 10:00 - 11:00 PM | Wednesday: {a}:00 PM - {b}:00 PM",
    "   ",
    "<b>Sunday: {a}:00 PM - {b}:00 PM</b>",
    "Daily from {a} to {b}",
    f"Saturday: {{a}} {EN} {{b}}pm | Sunday:  {{a}}:00pm{ZERO}-{ZERO}{{b}}:00pm",
    "Friday: {a}:00 PM - {b}:00 PM - late | Sunday: 12:00 AM - 2:00 AM",
    "Sunday: 12pm - {b}pm | Sunday: 9pm - 11pm | Monday: 11 AM - {a} PM",
    "Saturday: 4 - 6 pm Sunday: 4 - 6 pm",
]
PRICE_LEVELS = [
    "PRICE_LEVEL_INEXPENSIVE", "PRICE_LEVEL_MODERATE", "PRICE_LEVEL_EXPENSIVE",
    "PRICE_LEVEL_VERY_EXPENSIVE", "",
]
SOURCES = [
    "Google Places API", "Website (AI parsed, high confidence)", "Manual", "", "Yelp",
    "Google Places API (Happy Hours)", "google", "AI guess",
]
# Rows: place_id, restaurant_name, happy_hour_times, source, freshness_date.
OVERRIDES = [
    ("P000000001", "Venue 0", "Sunday: 1:00 PM - 2:00 PM", "Manual", "2026-04-19"),
    ("P000000002", "Venue 1", "", "Manual", "2026-04-19"),
    ("", "Venue 1", "Monday: 1:00 PM - 2:00 PM", "Manual", ""),
    ("", "Venue 5", "Tuesday: 5:00 PM - 6:00 PM", "", "2026-05-02"),
    ("P000000020", "Venue 99", "Sunday: 4:00 PM - 6:00 PM", "Owner", "2026-05-03"),
    ("P000000020", "Venue 10", "Sunday: 5:00 PM - 7:00 PM", "Owner", ""),
    ("", "Venue 11", "Friday: 1:00 PM - 2:00 PM", "Manual", "2026-01-01"),
    ("", "Venue 11", "Friday: 2:00 PM - 3:00 PM", "Phone", "2026-01-02"),
    ("P000000040", "", "Friday: 2:00 PM - 3:00 PM", "Phone", "2026-01-02"),
    ("P999999999", "Venue 23", "Sunday: 3:00 PM - 5:00 PM", "Manual", "2026-02-02"),
    ("", "No Such Venue", "Sunday: 3:00 PM - 5:00 PM", "Manual", "2026-02-02"),
    ("P000000061", "Venue 30", "Sunday: Closed", "Manual", "2026-02-03"),
]


def pick(values: list[str], k: Column) -> Column:
    """Value number ``k mod n`` of a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int") + 1)


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def place_key(k: Column) -> Column:
    return F.concat(F.lit("P"), padded(k, 9))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per order, in key order ``k``."""
    k = F.col("k")

    schedule = pick(SCHEDULES, k)
    for mark, value in (("{a}", k % 5 + 1), ("{b}", k % 4 + 6)):
        schedule = F.replace(schedule, F.lit(mark), value.cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    columns = [
        k,
        F.when(k % 23 == 0, "").otherwise(place_key(k)).alias("place_id"),
        F.concat(F.lit("Venue "), F.floor(k / 2).cast("string")).alias("restaurant_name"),
        F.concat(
            F.col("o_custkey").cast("string"), F.lit(" Street, San Diego, CA 92"), padded(k % 200, 3)
        ).alias("address"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("+1 619-"), padded(k % 10000, 4))).alias("phone_number"),
        F.when(k % 5 == 0, "").otherwise(
            F.concat(F.lit("https://venue"), k.cast("string"), F.lit(".example.com/"))
        ).alias("website_url"),
        schedule.alias("happy_hour_times"),
        F.when(k % 3 == 0, "").otherwise("Monday: 9:00 AM - 5:00 PM | Tuesday: Closed").alias("regular_hours"),
        F.concat((k % 5).cast("string"), F.lit("."), (k % 10).cast("string")).alias("rating"),
        F.when(k % 50 == 0, "").otherwise((k % 50).cast("string")).alias("review_count"),
        pick(PRICE_LEVELS, k).alias("price_level"),
        pick(SOURCES, k).alias("source"),
        F.when(k % 97 == 0, "bad").otherwise(
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")), "yyyy-MM-dd")
        ).alias("freshness_date"),
        F.when(k % 31 == 0, "").otherwise(
            F.concat(F.lit("32."), (k * 7919 % 2400 + 6400).cast("string"))
        ).alias("latitude"),
        F.when(k % 37 == 0, "").otherwise(
            F.concat(F.lit("-117."), padded(k * 104729 % 2000 + 801, 4))
        ).alias("longitude"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Deal "), (k % 8).cast("string"))).alias("menu_summary"),
    ]
    # The numbers behind the two texts; a division of integers is as exact as
    # reading the text and cheap enough to be repeated in conditions.
    lat, lng = (k * 7919 % 2400 + 326400) / 10000, -((k * 104729 % 2000 + 1170801) / 10000)
    return rows.select(
        *columns, F.when(k % 31 != 0, lat).alias("lat"), F.when(k % 37 != 0, lng).alias("lng")
    )


def menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One menu row per part; ``ord`` is the file order, some ids are blank."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("ord"),
        F.when(k % 3 == 0, "").otherwise(place_key(k % 1500)).alias("place_id"),
        F.concat(F.lit("Venue "), F.floor(k / 3).cast("string")).alias("restaurant_name"),
        F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("cheapest_drink"),
        F.when(k % 7 == 0, "").otherwise(
            F.concat((k % 9 + 1).cast("string"), F.lit("."), padded(k % 100, 2))
        ).alias("cheapest_drink_price"),
        F.col("p_type").alias("cheapest_food"),
        F.when(k % 11 == 0, "n/a").otherwise((k % 20).cast("string")).alias("cheapest_food_price"),
        F.concat(F.lit("$"), (k % 9 + 1).cast("string"), F.lit(" "), F.col("p_brand")).alias("menu_summary"),
        F.when(k % 2 == 0, "").otherwise("/menu").alias("menu_url"),
    )


def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per line item; the price is missing now and then."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("place_k"),
        F.struct(
            F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        ).alias("item_ord"),
        F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("name"),
        F.when(F.col("l_partkey") % 7 != 0, F.floor(F.col("l_quantity") / 10)).alias("price"),
        F.when(F.col("l_linenumber") % 2 == 0, "food").otherwise("drink").alias("category"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override rows: a fixed dozen, plus one per customer keyed by id or by name."""
    k = F.col("c_custkey")
    grown = table(spark, sf_dir, "customer").select(
        (k + len(OVERRIDES)).alias("ord"),
        F.when(k % 2 == 0, "").otherwise(place_key(k * 3)).alias("place_id"),
        F.concat(F.lit("Venue "), (k * 4 + 100).cast("string")).alias("restaurant_name"),
        F.when(k % 7 == 0, "").otherwise(
            F.concat(F.lit("Sunday: "), (k % 5 + 1).cast("string"), F.lit(":00 PM - 8:00 PM"))
        ).alias("happy_hour_times"),
        F.when(k % 5 == 0, "").otherwise("Manual").alias("source"),
        F.when(k % 3 == 0, "").otherwise("2026-03-03").alias("freshness_date"),
    )
    fixed = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(OVERRIDES)],
        "ord long, place_id string, restaurant_name string, happy_hour_times string, "
        "source string, freshness_date string",
    )
    return grown.unionByName(fixed)


# --- the same in SQL ---------------------------------------------------------

def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_pick(values: list[str], k: str) -> str:
    return "([" + ", ".join(sql_text(v) for v in values) + f"])[CAST({k} % {len(values)} AS INT) + 1]"


def _sql_key(k: str) -> str:
    return f"'P' || lpad(CAST({k} AS VARCHAR), 9, '0')"


PLACES_SQL = f"""
places AS (
  SELECT p0.*, TRY_CAST(nullif(latitude, '') AS DOUBLE) AS lat, TRY_CAST(nullif(longitude, '') AS DOUBLE) AS lng
  FROM (
    SELECT k,
      CASE WHEN k % 23 = 0 THEN '' ELSE {_sql_key('k')} END AS place_id,
      'Venue ' || (k // 2) AS restaurant_name,
      o_custkey || ' Street, San Diego, CA 92' || lpad(CAST(k % 200 AS VARCHAR), 3, '0') AS address,
      CASE WHEN k % 11 = 0 THEN '' ELSE '+1 619-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone_number,
      CASE WHEN k % 5 = 0 THEN '' ELSE 'https://venue' || k || '.example.com/' END AS website_url,
      replace(replace({_sql_pick(SCHEDULES, 'k')}, '{{a}}', CAST(k % 5 + 1 AS VARCHAR)),
        '{{b}}', CAST(k % 4 + 6 AS VARCHAR)) AS happy_hour_times,
      CASE WHEN k % 3 = 0 THEN '' ELSE 'Monday: 9:00 AM - 5:00 PM | Tuesday: Closed' END AS regular_hours,
      (k % 5) || '.' || (k % 10) AS rating,
      CASE WHEN k % 50 = 0 THEN '' ELSE CAST(k % 50 AS VARCHAR) END AS review_count,
      {_sql_pick(PRICE_LEVELS, 'k')} AS price_level,
      {_sql_pick(SOURCES, 'k')} AS source,
      CASE WHEN k % 97 = 0 THEN 'bad'
        ELSE strftime(DATE '2024-01-01' + CAST(k % 90 AS INT), '%Y-%m-%d') END AS freshness_date,
      CASE WHEN k % 31 = 0 THEN '' ELSE '32.' || (k * 7919 % 2400 + 6400) END AS latitude,
      CASE WHEN k % 37 = 0 THEN ''
        ELSE '-117.' || lpad(CAST(k * 104729 % 2000 + 801 AS VARCHAR), 4, '0') END AS longitude,
      CASE WHEN k % 4 = 0 THEN '' ELSE 'Deal ' || (k % 8) END AS menu_summary
    FROM (SELECT o_orderkey AS k, o_custkey FROM orders)
  ) p0
)"""

MENU_SQL = f"""
menu AS (
  SELECT p_partkey AS ord,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {_sql_key('p_partkey % 1500')} END AS place_id,
    'Venue ' || (p_partkey // 3) AS restaurant_name,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS cheapest_drink,
    CASE WHEN p_partkey % 7 = 0 THEN ''
      ELSE (p_partkey % 9 + 1) || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') END AS cheapest_drink_price,
    p_type AS cheapest_food,
    CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE CAST(p_partkey % 20 AS VARCHAR) END AS cheapest_food_price,
    '$' || (p_partkey % 9 + 1) || ' ' || p_brand AS menu_summary,
    CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/menu' END AS menu_url
  FROM part
)"""

MENU_ITEMS_SQL = """
menu_items AS (
  SELECT l_orderkey AS place_k, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    'Item ' || l_partkey AS name,
    CASE WHEN l_partkey % 7 <> 0 THEN CAST(floor(l_quantity / 10) AS BIGINT) END AS price,
    CASE WHEN l_linenumber % 2 = 0 THEN 'food' ELSE 'drink' END AS category
  FROM lineitem
)"""

OVERRIDES_SQL = f"""
overrides AS (
  SELECT c_custkey + {len(OVERRIDES)} AS ord,
    CASE WHEN c_custkey % 2 = 0 THEN '' ELSE {_sql_key('c_custkey * 3')} END AS place_id,
    'Venue ' || (c_custkey * 4 + 100) AS restaurant_name,
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Sunday: ' || (c_custkey % 5 + 1) || ':00 PM - 8:00 PM' END
      AS happy_hour_times,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Manual' END AS source,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '2026-03-03' END AS freshness_date
  FROM customer
  UNION ALL
  SELECT * FROM (VALUES {", ".join(
      "(" + ", ".join([str(i)] + [sql_text(v) for v in row]) + ")" for i, row in enumerate(OVERRIDES))})
)"""


def with_sql(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()
