"""Queries about weekly schedules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import schedule as sched
from ..functions.geo import EARTH_MILES, distance_label
from ..functions.text import not_blank
from ..operators import proximity
from ..operators import schedule as jobs
from ..operators import sessions
from . import derived

AS_OF = "2026-04-19 16:00:00"  # a Sunday
DAY, MINUTE = 0, 960
HOME = (32.7157, -117.1611)


# --- SQL building blocks -----------------------------------------------------

def _inherit(a: str, b: str) -> str:
    return (
        f"CASE WHEN NOT regexp_matches({a}, '(?i)(am|pm)') AND regexp_matches({b}, '(?i)(am|pm)') "
        f"THEN {a} || ' ' || regexp_extract({b}, '(?i)(am|pm)', 1) ELSE {a} END"
    )


def _squeeze(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _canonical(t: str) -> str:
    hour = rf"TRY_CAST(regexp_extract({t}, '^(\d{{1,2}}):\d\d$', 1) AS INT)"
    p12 = r"'(?i)^(\d{1,2})(?::(\d{2}))?\s*(am|pm|a\.m\.|p\.m\.)'"
    return (
        f"CASE WHEN {hour} <= 23 THEN ((({hour} + 11) % 12) + 1) || ':' || right({t}, 2) "
        f"|| CASE WHEN {hour} >= 12 THEN ' PM' ELSE ' AM' END "
        f"WHEN regexp_matches({t}, {p12}) THEN CAST(regexp_extract({t}, {p12}, 1) AS INT) || ':' || "
        f"CASE WHEN regexp_extract({t}, {p12}, 2) = '' THEN '00' ELSE regexp_extract({t}, {p12}, 2) END || "
        f"CASE WHEN lower(left(regexp_extract({t}, {p12}, 3), 1)) = 'a' THEN ' AM' ELSE ' PM' END "
        f"ELSE {t} END"
    )


def _minutes(t: str) -> str:
    p = r"'(?i)(\d+):(\d+)\s*(am|pm)'"
    hour = f"TRY_CAST(regexp_extract({t}, {p}, 1) AS INT)"
    return (
        f"(({hour} % 12 + CASE WHEN lower(regexp_extract({t}, {p}, 3)) = 'pm' THEN 12 ELSE 0 END) * 60 "
        f"+ TRY_CAST(regexp_extract({t}, {p}, 2) AS INT))"
    )


DAY_LIST = "[" + ", ".join(f"'{d.lower()}'" for d in sched.DAYS) + "]"

CLEAN_SQL = r"""
cleaned AS (
  SELECT k, happy_hour_times AS raw,
    regexp_replace(regexp_replace(regexp_replace(happy_hour_times,
      '[\x{202f}\x{00a0}\x{2000}-\x{200b}]', ' ', 'g'), '[\x{2013}\x{2014}]', '-', 'g'),
      '([a-z0-9])((monday|tuesday|wednesday|thursday|friday|saturday|sunday):)', '\1 | \2', 'gi') AS t
  FROM places
),
entry_raw AS (
  SELECT k, raw, unnest(string_split(t, ' | ')) AS e, generate_subscripts(string_split(t, ' | '), 1) - 1 AS entry_ord
  FROM cleaned
)"""
ENTRY_SQL = rf"""
entry AS (
  SELECT k, entry_ord, day_raw, CAST(nullif(coalesce(list_position({DAY_LIST}, lower(day_raw)), 0), 0) - 1 AS INT)
    AS day_idx, body, lower(body) = 'closed' AS closed
  FROM (
    SELECT k, entry_ord, trim(regexp_extract(e, '^([^:]+):\s*(.+)$', 1)) AS day_raw,
      trim(regexp_extract(e, '^([^:]+):\s*(.+)$', 2)) AS body
    FROM entry_raw WHERE trim(raw) <> ''
  )
)"""
SESSION_SQL = rf"""
sess0 AS (
  SELECT k, entry_ord, day_raw, day_idx, unnest(string_split(body, ', ')) AS s,
    generate_subscripts(string_split(body, ', '), 1) - 1 AS session_ord
  FROM entry WHERE NOT closed AND body <> ''
),
sess1 AS (
  SELECT *, trim(string_split(s, ' - ')[1]) AS start_txt, trim(string_split(s, ' - ')[2]) AS end_txt
  FROM sess0 WHERE len(string_split(s, ' - ')) = 2
),
sess2 AS (
  SELECT *, {_squeeze(_inherit('start_txt', 'end_txt'))} AS sc, {_squeeze('end_txt')} AS ec FROM sess1
),
sess3 AS (SELECT *, {_canonical('sc')} AS sn, {_canonical('ec')} AS en FROM sess2),
sess AS (
  SELECT k, entry_ord, day_raw, day_idx, session_ord, start_txt, end_txt, sn, en,
    {_minutes('sn')} AS start_min, {_minutes('en')} AS end_min,
    coalesce({_minutes('sn')}, 0) AS start_min0, coalesce({_minutes('en')}, 0) AS end_min0
  FROM sess3
)"""
FLEXIBLE = [derived.PLACES_SQL, CLEAN_SQL, ENTRY_SQL, SESSION_SQL]


def sql_within(start: str, end: str, minute: str) -> str:
    return (
        f"CASE WHEN {end} < {start} THEN {minute} >= {start} OR {minute} <= {end} "
        f"ELSE {minute} BETWEEN {start} AND {end} END"
    )


def active_sql(day: int = DAY, minute: int = MINUTE) -> str:
    return f"""
active AS (
  SELECT DISTINCT k FROM sess WHERE day_idx = {day} AND {sql_within('start_min0', 'end_min0', str(minute))}
)"""


def status_sql(day: int = DAY, minute: int = MINUTE) -> str:
    return f"""
first_entry AS (
  SELECT k, min(entry_ord) AS entry_ord FROM entry WHERE day_idx = {day} GROUP BY k
),
today AS (
  SELECT f.k, e.closed, s.start_min0, s.end_min0
  FROM first_entry f JOIN entry e USING (k, entry_ord)
  LEFT JOIN sess s ON s.k = f.k AND s.entry_ord = f.entry_ord AND s.session_ord = 0
),
offers AS (SELECT DISTINCT k FROM entry WHERE NOT closed AND body <> ''),
status AS (
  SELECT p.k, CASE
    WHEN trim(p.happy_hour_times) = '' THEN 'NO_HAPPY_HOUR'
    WHEN a.k IS NOT NULL THEN 'ACTIVE'
    WHEN t.closed THEN 'CLOSED_TODAY'
    WHEN {minute} < t.start_min0 THEN 'LATER_TODAY'
    WHEN {minute} > t.end_min0 THEN 'PASSED_TODAY'
    WHEN o.k IS NOT NULL THEN 'NO_HAPPY_HOUR_TODAY'
    ELSE 'NO_HAPPY_HOUR' END AS status
  FROM places p LEFT JOIN active a USING (k) LEFT JOIN today t USING (k) LEFT JOIN offers o USING (k)
)"""


STATUS_LABEL_SQL = "CASE status " + " ".join(
    f"WHEN '{code}' THEN '{label}'" for code, label in sched.STATUS_LABELS.items()
) + " ELSE '' END"


def miles_sql(lat: str, lng: str, at: tuple[float, float] = HOME, radius: float = EARTH_MILES) -> str:
    half_lat, half_lng = f"radians({at[0]} - {lat}) / 2", f"radians({at[1]} - {lng}) / 2"
    a = (
        f"(pow(sin({half_lat}), 2) + cos(radians({lat})) * cos(radians({at[0]})) * pow(sin({half_lng}), 2))"
    )
    return f"(2.0 * {radius} * atan2(sqrt({a}), sqrt(1 - {a})))"


def label_sql(miles: str) -> str:
    return (
        f"CASE WHEN {miles} < 0.1 THEN CAST(floor({miles} * 5280 + 0.5) AS BIGINT) || ' ft' "
        f"WHEN {miles} < 10 THEN (CAST(floor({miles} * 10 + 0.5) AS BIGINT) // 10) || '.' || "
        f"(CAST(floor({miles} * 10 + 0.5) AS BIGINT) % 10) || ' mi' "
        f"ELSE CAST(floor({miles} + 0.5) AS BIGINT) || ' mi' END"
    )


# --- queries -----------------------------------------------------------------

def open_now_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: places with a deal now, nearest first, with status and labels."""
    near = proximity.with_distance(
        jobs.active_at(derived.places(spark, sf_dir), AS_OF), HOME, radius=EARTH_MILES
    )
    top = proximity.nearest_first(near.withColumn("distance", F.round("distance", 6)), ["k"], limit=100)
    shown = jobs.status_at(top, AS_OF)
    return shown.select(
        "k", "place_id", "restaurant_name", "status", "status_label", "distance",
        distance_label(F.col("distance")).alias("distance_label"),
    )


def active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.active_at(derived.places(spark, sf_dir), AS_OF).select("k", "place_id", "happy_hour_times")


def active_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.active_at(derived.places(spark, sf_dir), AS_OF, mode="strict").select("k", "happy_hour_times")


def active_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunday 00:30, counting what began on Saturday night."""
    return jobs.active_at(
        derived.places(spark, sf_dir), "2026-04-19 00:30:00", carry_to_next_day=True
    ).select("k", "happy_hour_times")


def status_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status_at(derived.places(spark, sf_dir), AS_OF).select("k", "status", "status_label")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status_at(derived.places(spark, sf_dir), AS_OF).groupBy("status").agg(
        F.count("*").alias("n")
    )


def marker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("happy_hour_times")
    return derived.places(spark, sf_dir).select(
        "k", labels.marker_status(not_blank(c), jobs.active_column("happy_hour_times", AS_OF)).alias("marker")
    )


def schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.schedule_explode(derived.places(spark, sf_dir), ["k"])


def schedule_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.schedule_sessions(derived.places(spark, sf_dir), ["k"])


def schedule_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.schedule_normalize(derived.places(spark, sf_dir)).select("k", "schedule_text")


def day_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, sunday = F.col("happy_hour_times"), F.lit(0)
    return derived.places(spark, sf_dir).select(
        "k",
        sched.display_line(c, sunday).alias("display_line"),
        sched.day_schedule(c, sunday).alias("day_schedule"),
        sched.rendered_schedule(c).alias("rendered"),
    )


def weekly_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.weekly_occupancy(derived.places(spark, sf_dir))


def schedule_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule text from structured day/time items, blanks skipped."""
    k = F.col("k")
    items = F.array(*[
        F.struct(
            F.when(k % 7 == i, "").otherwise(name).alias("day"),
            F.when(k % 5 == i, "").otherwise(F.concat((k % 6 + 1).cast("string"), F.lit(" - 9 PM"))).alias("times"),
        )
        for i, name in enumerate(sched.DAYS)
    ])
    return derived.places(spark, sf_dir).select("k", sched.schedule_from_items(items).alias("schedule_text"))


def regular_hour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.text_lines(derived.places(spark, sf_dir), ["k"], "regular_hours")


def chosen_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's weekday-and-hour choice moved into the week of 2026-04-22."""
    events = derived.table(spark, sf_dir, "events")
    day, hour = F.col("event_id") % 7, F.floor(F.col("event_id") / 7) % 24
    today = F.date_add(F.lit(date(2026, 4, 22)), (F.col("user_id") % 30).cast("int"))
    return events.select(
        "event_id",
        F.date_format(jobs.instant_column(day, hour.cast("int"), today), "yyyy-MM-dd HH:mm").alias("instant"),
    )


def active_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event, how many places had a deal at that instant, and the first of them."""
    events = derived.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"))
    found = sessions.active_sweep(derived.places(spark, sf_dir), events, "at", "k")
    return found.select("event_id", "n_active", "first_active")


def active_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every full hour of the week in which some user saw an error, beside every place that had a deal then."""
    hours = derived.table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.dayofweek("ts").alias("weekday"), F.date_trunc("hour", "ts").alias("at")
    ).groupBy("weekday", F.hour("at").alias("hour")).agg(F.min("at").alias("at"))
    pairs = sessions.active_pairs(derived.places(spark, sf_dir), hours, "at", ["k"])
    return pairs.select((F.col("weekday") - 1).alias("day_idx"), "hour", "k")


def labels_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.places(spark, sf_dir).select(
        "k",
        labels.price_sign(F.col("price_level")).alias("price_sign"),
        labels.local_phone(F.col("phone_number")).alias("phone"),
        labels.source_label(F.col("source")).alias("source_label"),
        labels.short_address(F.col("address")).alias("short_address"),
        labels.date_label(F.col("freshness_date")).alias("date_label"),
    )


QUERIES = {
    "open_now_nearest": open_now_nearest,
    "active_at": active_at,
    "active_strict": active_strict,
    "active_carried": active_carried,
    "status_at": status_at,
    "status_counts": status_counts,
    "marker_status": marker_status,
    "schedule_rows": schedule_rows,
    "schedule_sessions": schedule_sessions,
    "schedule_normalized": schedule_normalized,
    "day_line": day_line,
    "weekly_occupancy": weekly_occupancy,
    "schedule_rebuilt": schedule_rebuilt,
    "regular_hour_lines": regular_hour_lines,
    "chosen_instants": chosen_instants,
    "active_sweep": active_sweep,
    "active_pairs": active_pairs,
    "labels_projection": labels_projection,
}

_STRICT = rf"""
strict0 AS (
  SELECT k, entry_ord, string_split(e, ': ')[1] AS d, string_split(e, ': ')[2] AS body
  FROM entry_raw WHERE trim(raw) <> ''
),
strict1 AS (
  SELECT k, entry_ord, trim(d) AS day, lower(body) = 'closed' AS closed, len(string_split(body, ', ')) >= 2 AS second,
    string_split(trim(string_split(body, ', ')[1]), ' - ') AS one,
    CASE WHEN len(string_split(body, ', ')) >= 2 THEN string_split(trim(string_split(body, ', ')[2]), ' - ') END AS two
  FROM strict0 WHERE d <> '' AND body <> ''
),
strict AS (
  SELECT k, CAST(entry_ord AS INT) AS entry_ord, day,
    CASE WHEN closed THEN '' ELSE trim(one[1]) END AS start,
    CASE WHEN closed THEN '' ELSE trim(one[2]) END AS "end",
    NOT closed AND second AS second,
    CASE WHEN NOT closed AND len(two) = 2 THEN trim(two[1]) ELSE '' END AS start2,
    CASE WHEN NOT closed AND len(two) = 2 THEN trim(two[2]) ELSE '' END AS end2
  FROM strict1 WHERE closed OR len(one) = 2
)"""
_STRICT_SUNDAY = """
strict_day AS (
  SELECT s.* FROM strict s JOIN (
    SELECT k, min(entry_ord) AS entry_ord FROM strict WHERE day = 'Sunday' GROUP BY k
  ) USING (k, entry_ord)
)"""
_PAIR = (
    "start || ' - ' || \"end\" || CASE WHEN second AND start2 <> '' THEN ', ' || start2 || ' - ' || end2 ELSE '' END"
)
_DISPLAY = rf"""
disp0 AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY o) AS entry_ord, trim(e) AS e FROM (
    SELECT k, unnest(string_split(dt, ' | ')) AS e, generate_subscripts(string_split(dt, ' | '), 1) AS o
    FROM (
      SELECT k, regexp_replace(t, '([ap]m)-+([0-9])', '\1 - \2', 'gi') AS dt FROM cleaned
      WHERE trim(raw) <> '' AND NOT regexp_matches(raw, '<[^>]+>')
    )
  ) WHERE trim(e) <> ''
),
disp1 AS (
  SELECT *, CASE WHEN position(': ' IN e) > 0 THEN trim(left(e, position(': ' IN e) - 1)) ELSE '' END AS day,
    CASE WHEN position(': ' IN e) > 0 THEN trim(substr(e, position(': ' IN e) + 2)) ELSE '' END AS body
  FROM disp0
),
disp2 AS (
  SELECT k, entry_ord, so, {_squeeze("regexp_replace(s, '-+', ' - ', 'g')")} AS s FROM (
    SELECT k, entry_ord, unnest(string_split(body, ', ')) AS s, generate_subscripts(string_split(body, ', '), 1) AS so
    FROM disp1 WHERE day <> '' AND body <> '' AND lower(body) <> 'closed'
  )
),
disp3 AS (
  SELECT k, entry_ord, so, s, len(string_split(s, ' - ')) = 2 AS two,
    {_inherit("trim(string_split(s, ' - ')[1])", "trim(string_split(s, ' - ')[2])")} AS a,
    trim(string_split(s, ' - ')[2]) AS b
  FROM disp2
),
disp4 AS (
  SELECT k, entry_ord, string_agg(CASE WHEN two THEN {_canonical('a')} || ' - ' || {_canonical('b')} ELSE s END, ', '
    ORDER BY so) AS txt
  FROM disp3 GROUP BY k, entry_ord
),
disp AS (
  SELECT d.k, d.entry_ord, CASE WHEN day = '' OR body = '' THEN e WHEN lower(body) = 'closed' THEN day || ': Closed'
    ELSE day || ': ' || txt END AS line
  FROM disp1 d LEFT JOIN disp4 USING (k, entry_ord)
)"""

_BASE = FLEXIBLE + [active_sql()]
_rebuilt_items = " || ".join(
    f"CASE WHEN k % 7 = {i} OR k % 5 = {i} THEN '' ELSE ' | {name}: ' || (k % 6 + 1) || ' - 9 PM' END"
    for i, name in enumerate(sched.DAYS)
)

ORACLE = {
    "open_now_nearest": derived.with_sql(
        _BASE + [status_sql(), f"near AS (SELECT *, round({miles_sql('lat', 'lng')}, 6) AS distance FROM places)"],
        f"""SELECT k, place_id, restaurant_name, status, {STATUS_LABEL_SQL} AS status_label, distance,
              {label_sql('distance')} AS distance_label
            FROM near JOIN active USING (k) JOIN status USING (k)
            ORDER BY distance NULLS LAST, k LIMIT 100""",
    ),
    "active_at": derived.with_sql(
        _BASE, "SELECT k, place_id, happy_hour_times FROM places JOIN active USING (k)"
    ),
    "active_strict": derived.with_sql(
        FLEXIBLE + [_STRICT, _STRICT_SUNDAY],
        f"""SELECT k, happy_hour_times FROM places JOIN strict_day USING (k)
            WHERE start <> '' AND (({sql_within(_minutes('start'), _minutes('"end"'), str(MINUTE))})
              OR (second AND ({sql_within(_minutes('start2'), _minutes('end2'), str(MINUTE))})))""",
    ),
    "active_carried": derived.with_sql(
        FLEXIBLE,
        """SELECT k, happy_hour_times FROM places WHERE k IN (
             SELECT k FROM sess WHERE
               (day_idx = 0 AND 30 >= start_min0 AND (end_min0 < start_min0 OR 30 <= end_min0))
               OR (day_idx = 6 AND end_min0 < start_min0 AND 30 <= end_min0))""",
    ),
    "status_at": derived.with_sql(
        _BASE + [status_sql()], f"SELECT k, status, {STATUS_LABEL_SQL} AS status_label FROM status"
    ),
    "status_counts": derived.with_sql(
        _BASE + [status_sql()], "SELECT status, count(*) AS n FROM status GROUP BY status"
    ),
    "marker_status": derived.with_sql(
        _BASE,
        """SELECT p.k, CASE WHEN a.k IS NOT NULL THEN 'Active now' WHEN trim(happy_hour_times) <> ''
             THEN 'Not active now' ELSE 'No Happy Hour' END AS marker
           FROM places p LEFT JOIN active a USING (k)""",
    ),
    "schedule_rows": derived.with_sql(
        FLEXIBLE,
        """SELECT k, CAST(entry_ord AS INT) AS entry_ord, day_raw, day_idx, false AS closed,
             CAST(session_ord AS INT) AS session_ord, start_txt, end_txt, start_min, end_min, start_min0, end_min0,
             end_min0 < start_min0 AS wraps FROM sess
           UNION ALL SELECT k, CAST(entry_ord AS INT), day_raw, day_idx, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
             NULL FROM entry WHERE closed""",
    ),
    "schedule_sessions": derived.with_sql([derived.PLACES_SQL, CLEAN_SQL, _STRICT], "SELECT * FROM strict"),
    "schedule_normalized": derived.with_sql(
        [derived.PLACES_SQL, CLEAN_SQL, _DISPLAY],
        """SELECT k, coalesce(txt, '') AS schedule_text FROM places LEFT JOIN (
             SELECT k, string_agg(line, ' | ' ORDER BY entry_ord) AS txt FROM disp GROUP BY k) USING (k)""",
    ),
    "day_line": derived.with_sql(
        [derived.PLACES_SQL, CLEAN_SQL, _DISPLAY, _STRICT, _STRICT_SUNDAY],
        f"""SELECT p.k, coalesce(d.line, '') AS display_line,
              coalesce(CASE WHEN s.start <> '' THEN {_PAIR} END, '') AS day_schedule,
              CASE WHEN trim(p.happy_hour_times) = '' THEN 'No happy hour info'
                ELSE coalesce(r.txt, p.happy_hour_times) END AS rendered
            FROM places p
            LEFT JOIN (SELECT k, min_by(line, entry_ord) AS line FROM disp
                       WHERE starts_with(lower(line), 'sunday') GROUP BY k) d USING (k)
            LEFT JOIN strict_day s USING (k)
            LEFT JOIN (SELECT k, string_agg(CASE WHEN start = '' THEN day || ': Closed'
                         ELSE day || ': ' || {_PAIR} END, ' | ' ORDER BY entry_ord) AS txt
                       FROM strict GROUP BY k) r USING (k)""",
    ),
    "weekly_occupancy": derived.with_sql(
        FLEXIBLE,
        f"""SELECT day_idx, CAST(h AS INT) AS hour, CASE WHEN h = 0 THEN '12:00 AM' WHEN h < 12 THEN h || ':00 AM'
              WHEN h = 12 THEN '12:00 PM' ELSE (h - 12) || ':00 PM' END AS hour_label,
              count(DISTINCT k) AS n_active
            FROM sess, range(24) AS r(h)
            WHERE day_idx IS NOT NULL AND {sql_within('start_min0', 'end_min0', 'h * 60')}
            GROUP BY day_idx, h""",
    ),
    "schedule_rebuilt": derived.with_sql(
        [derived.PLACES_SQL], f"SELECT k, substr({_rebuilt_items}, 4) AS schedule_text FROM places"
    ),
    "regular_hour_lines": derived.with_sql(
        [derived.PLACES_SQL],
        """SELECT k, CAST(generate_subscripts(string_split(regular_hours, ' | '), 1) - 1 AS INT) AS line_ord,
             unnest(string_split(regular_hours, ' | ')) AS line FROM places WHERE regular_hours <> ''""",
    ),
    "chosen_instants": """
        SELECT event_id, strftime(CAST(today AS TIMESTAMP) + to_days(CAST(event_id % 7 - dayofweek(today) AS INT))
          + to_hours(CAST((event_id // 7) % 24 AS INT)), '%Y-%m-%d %H:%M') AS instant
        FROM (SELECT event_id, DATE '2026-04-22' + CAST(user_id % 30 AS INT) AS today FROM events)""",
    "active_sweep": derived.with_sql(
        FLEXIBLE,
        f"""SELECT event_id, coalesce(n_active, 0) AS n_active, first_active
            FROM (SELECT event_id, CAST(dayofweek(ts) AS INT) AS d, CAST(hour(ts) * 60 + minute(ts) AS INT) AS m FROM events)
            LEFT JOIN (
              SELECT d, m, count(DISTINCT k) AS n_active, min(k) AS first_active
              FROM sess JOIN (SELECT DISTINCT CAST(dayofweek(ts) AS INT) AS d, CAST(hour(ts) * 60 + minute(ts) AS INT) AS m FROM events)
                ON day_idx = d AND {sql_within('start_min0', 'end_min0', 'm')}
              GROUP BY d, m) USING (d, m)""",
    ),
    "active_pairs": derived.with_sql(
        FLEXIBLE,
        f"""SELECT DISTINCT day_idx, h AS hour, k FROM sess JOIN (
              SELECT DISTINCT CAST(dayofweek(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h FROM events WHERE event_type = 'error')
            ON day_idx = d AND {sql_within('start_min0', 'end_min0', 'h * 60')}""",
    ),
    "labels_projection": derived.with_sql(
        [derived.PLACES_SQL],
        r"""SELECT k,
             CASE price_level WHEN 'PRICE_LEVEL_INEXPENSIVE' THEN '$' WHEN 'PRICE_LEVEL_MODERATE' THEN '$$'
               WHEN 'PRICE_LEVEL_EXPENSIVE' THEN '$$$' WHEN 'PRICE_LEVEL_VERY_EXPENSIVE' THEN '$$$$' ELSE '' END
               AS price_sign,
             regexp_replace(phone_number, '^\+1\s*', '') AS phone,
             CASE WHEN source = '' THEN 'Unknown'
               WHEN contains(source, 'google') OR contains(source, 'Google') THEN 'Google Maps'
               WHEN contains(source, 'website') OR contains(source, 'Website') OR contains(source, 'AI') THEN 'Website'
               ELSE source END AS source_label,
             trim(regexp_replace(address, '(?i),\s*San Diego,?\s*(CA)?\s*\d{5}(-\d{4})?', '')) AS short_address,
             coalesce(strftime(TRY_CAST(freshness_date AS DATE), '%b %-d, %Y'), '') AS date_label
           FROM places""",
    ),
}
