"""Tables kept by key: lookups and upserts move only what is asked for or arrives."""

import pytest
from pyspark.sql import functions as F

from wherewhen.operators import incremental


def sides(frame):
    """Exchanges, and which of them stand above a scan of the stored table."""
    plan = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "simple")
    plan = plan.split("== Initial Plan ==")[0]
    return plan.count("Exchange "), plan


@pytest.fixture
def large_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshots_are_not_shuffled(spark, tmp_path, large_tables):
    snapshots = spark.range(2000).select(
        F.concat(F.lit("k"), (F.col("id") % 500).cast("string")).alias("key"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))).alias("cached_at"),
        F.when(F.col("id") % 7 == 0, "broken").otherwise('{"a": 1}').alias("payload"))
    incremental.store_by_key(snapshots, "snapshots_by_key", "key", buckets=8, path=str(tmp_path / "s"))
    try:
        held = spark.table("snapshots_by_key")
        keys = spark.createDataFrame([("k1",), ("k2",), ("k499",), ("none",), ("k1",)], "key string")
        as_of = "2023-11-15 00:00:00"
        valid = incremental.ttl_latest(held, as_of)
        found = incremental.lookup_stored(keys, valid)
        want = incremental.batch_lookup(keys.distinct(), incremental.ttl_latest(snapshots, as_of))
        assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
        count, plan = sides(found)
        assert count == 1 and "Bucketed: true" in plan  # the requested keys alone
        new = spark.createDataFrame([("k1", "x"), ("k1", "y"), ("brand new", "z")], "key string, payload string").withColumn(
            "cached_at", F.timestamp_seconds(F.lit(1_800_000_000) + F.ascii("payload")))
        one_each = incremental.last_per_key(held, ["key"], "cached_at")
        merged = incremental.upsert_stored(one_each, new)
        rows = {r.key: r.payload for r in merged.collect()}
        assert len(rows) == 501 and rows["k1"] == "y" and rows["brand new"] == "z" and rows["k3"] in ("broken", '{"a": 1}')
        count, plan = sides(merged)
        assert count == 1 and "Bucketed: true" in plan  # the arriving rows alone
    finally:
        spark.sql("DROP TABLE snapshots_by_key")


def test_places_by_id_are_not_shuffled(spark, tmp_path, large_tables):
    places = spark.range(1000).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("place_id"), F.lit("x").alias("restaurant_name"))
    incremental.store_by_key(places, "places_by_id", "place_id", buckets=8, path=str(tmp_path / "p"))
    try:
        asked = spark.createDataFrame([("P5",), ("P999",), ("P1000",)], "place_id string")
        found = incremental.lookup_stored(asked, spark.table("places_by_id"), "place_id")
        assert {r.place_id: r.restaurant_name for r in found.collect()} == {"P5": "x", "P999": "x", "P1000": None}
        count, plan = sides(found)
        assert count == 1 and "Bucketed: true" in plan
    finally:
        spark.sql("DROP TABLE places_by_id")
