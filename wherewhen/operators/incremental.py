"""What still has to be done: snapshots with a lifetime, fresh rows, pending rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import is_json
from ..functions.text import filled, iso_date
from .keyed import last_per_key, splittable_join, spread_key


def request_key(request: Column) -> Column:
    """Short stable key of a request struct; list its fields in name order."""
    return F.substring(F.md5(F.to_json(request)), 1, 16)


def ttl_latest(
    snapshots: DataFrame, as_of: datetime | str, ttl_days: float = 30, key: str = "key",
    cached_at: str = "cached_at", payload: str = "payload",
) -> DataFrame:
    """The last snapshot of every key, if it is still valid and readable.

    The last write replaces the earlier ones first: an expired or malformed
    last snapshot is a miss even if an older one would do.
    """
    now = F.lit(str(as_of)).cast("timestamp")
    latest = last_per_key(snapshots, [key], cached_at)
    age = F.unix_micros(now) - F.unix_micros(F.col(cached_at).cast("timestamp"))
    return latest.filter((age <= int(ttl_days * 86_400_000_000)) & is_json(F.col(payload)))


def batch_lookup(keys: DataFrame, valid: DataFrame, key: str = "key") -> DataFrame:
    """All requested keys; NULL where nothing valid is stored."""
    return splittable_join(keys, valid, key)


# --- stored by key ---------------------------------------------------------------

def store_by_key(rows: DataFrame, table: str, key: str, buckets: int = 256, path: str | None = None) -> None:
    """Keep a table in files by hash of its key, sorted by it.

    Lookups and upserts by that key read it without a shuffle: only what is asked
    for or arrives is moved. ``buckets`` is the number of tasks of such a join (with fewer
    than the session's shuffle partitions Spark moves the table after all); a key's
    rows are in one of them. ``path`` makes it an external table.
    """
    writer = rows.repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def lookup_stored(keys: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """All requested keys beside the rows of a table kept by ``store_by_key``; NULL where there are none.

    Requested keys are taken once. Only they are exchanged, to the table's buckets;
    as a key's stored rows are in one bucket anyway, a crowded one cannot be split.
    """
    return keys.select(key).distinct().join(stored, key, "left")


def upsert_stored(stored: DataFrame, rows: DataFrame, key: str = "key", order: str = "cached_at") -> DataFrame:
    """The stored rows with the last arriving row of each key in place of theirs; to be kept with ``store_by_key`` under a new name."""
    latest = last_per_key(rows.select(*stored.columns), [key], order).select(
        key, F.struct(*[c for c in stored.columns if c != key]).alias("__new")
    )
    rest = [c for c in stored.columns if c != key]
    both = stored.withColumn("__old", F.struct(*rest)).drop(*rest).join(latest, key, "full")
    return both.select(key, F.coalesce("__new", "__old").alias("__row")).select(key, "__row.*").select(*stored.columns)


def is_fresh(date: Column, as_of: datetime | str, days: int) -> Column:
    """Midnight of the date is at most ``days`` full days before ``as_of``."""
    if days <= 0:
        return F.lit(False)
    cutoff = F.lit(str(as_of)).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return F.coalesce(iso_date(date).cast("timestamp") >= cutoff, F.lit(False))


def fresh_ids(existing: DataFrame, as_of: datetime | str, days: int) -> DataFrame:
    return existing.filter(
        filled(F.col("place_id")) & is_fresh(F.col("freshness_date"), as_of, days)
    ).select("place_id").distinct()


def skip_fresh(candidates: DataFrame, fresh: DataFrame) -> DataFrame:
    """Candidates whose id is not fresh; rows without id go through.

    An anti join sends all NULL keys to one task, so missing ids get keys of
    their own.
    """
    seeds = [F.col(c) for c in candidates.columns]
    keyed = candidates.withColumn("__key", spread_key(F.nullif(F.col("place_id"), F.lit("")), *seeds))
    return splittable_join(keyed, fresh.select(F.col("place_id").alias("__key")), "__key", "left_anti").drop("__key")


def pending_schedules(places: DataFrame) -> DataFrame:
    return places.filter(~filled(F.col("happy_hour_times")))


def pending_menus(places: DataFrame) -> DataFrame:
    return places.filter(filled(F.col("website_url")) & ~filled(F.col("menu_summary")))


def success_rate(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Of the rows that had no value before, how many have one after."""
    selected = before.filter(~filled(F.col(column))).select(key)
    return selected.join(after.select(key, F.col(column).alias("__value")), key, "left").agg(
        F.count("*").alias("selected"),
        F.count_if(filled(F.col("__value"))).alias("succeeded"),
        F.round(F.try_divide(F.count_if(filled(F.col("__value"))) * 100, F.count("*")), 1).alias("percent"),
    )
