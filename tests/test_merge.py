"""Survivorship merge against a sequential restatement, and keyed lookups."""

import random

import pytest
from pyspark.sql import functions as F

from wherewhen.operators import incremental, keyed, merge

COLUMNS = ["place_id", "restaurant_name", "phone_number", "happy_hour_times", "cheapest_drink_price", "freshness_date"]
SCHEMA = (
    "ord long, place_id string, restaurant_name string, phone_number string, happy_hour_times string, "
    "cheapest_drink_price double, freshness_date string"
)
EXTRACTED = {"happy_hour_times", "cheapest_drink_price"}


def targets(existing, new, compat):
    """What each new row is about: an id, a name known without id, or the row itself."""
    ids = {r["place_id"] for r in existing if r["place_id"]}
    names = {r["restaurant_name"] for r in existing if not r["place_id"] and r["restaurant_name"]}
    if compat:  # an id counts as known from the first row that has it and no known name
        known = dict.fromkeys(ids, -1)
        for i, r in enumerate(new):
            if r["place_id"] and r["restaurant_name"] not in names:
                known.setdefault(r["place_id"], i)
        by_id = [known.get(r["place_id"], len(new)) <= i for i, r in enumerate(new)]
        by_name = [r["restaurant_name"] if r["restaurant_name"] in names else None for r in new]
    else:  # a known name belongs to the first new id that has it
        first = {}
        for r in new:
            if r["place_id"] and r["place_id"] not in ids and r["restaurant_name"] in names:
                first.setdefault(r["restaurant_name"], r["place_id"])
        owned = {pid: name for name, pid in reversed(first.items())}
        by_id = [bool(r["place_id"]) and r["place_id"] not in owned for r in new]
        by_name = [
            owned.get(r["place_id"]) if r["place_id"] else r["restaurant_name"] if r["restaurant_name"] in names else None for r in new
        ]
    return [
        ("id", r["place_id"]) if of_id else ("name", name) if name else ("row", i)
        for i, (r, of_id, name) in enumerate(zip(new, by_id, by_name))
    ]


def survivor(kind, rows, compat):
    """One row out of a target's rows, oldest first, each field on its own."""
    oldest, later = rows[0], rows[1:]

    def latest(field, counts):
        return next((r[field] for r in reversed(later) if counts(r[field])), oldest[field])

    out = {c: latest(c, bool if c in EXTRACTED else lambda v: v is not None) for c in COLUMNS}
    out["freshness_date"] = rows[-1]["freshness_date"]
    out["place_id"] = oldest["place_id"]
    if kind == "name":
        out["place_id"] = latest("place_id", (lambda v: True) if compat else bool)
    return out


def fold(existing, new, prune, compat):
    """Rows gathered by target, then folded field by field."""
    existing, new = ([dict(zip(["ord", *COLUMNS], r)) for r in rows] for rows in (existing, new))
    groups = {}
    for r in existing:  # the last row of an id or a name is the one that is known
        if r["place_id"] or r["restaurant_name"]:
            groups["id" if r["place_id"] else "name", r["place_id"] or r["restaurant_name"]] = [r]
    for target, r in zip(targets(existing, new, compat), new):
        groups.setdefault(target, []).append(r)
    seen = {r["place_id"] for r in new}
    kept = [survivor(kind, rows, compat) for (kind, key), rows in groups.items() if kind != "id" or not prune or key in seen]
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in kept)


def random_rows(rng, n, first):
    return [
        (
            first + i, rng.choice(["", "p1", "p2", "p3", "p4", None]) or "", rng.choice(["A", "B", "C", ""]),
            rng.choice([None, "", f"t{first + i}"]), rng.choice([None, "", f"h{first + i}"]),
            rng.choice([None, 0.0, float(first + i)]), rng.choice([None, f"d{first + i}"]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("prune", [True, False])
def test_merge_equals_the_sequential_fold(spark, compat, prune):
    """Many small directories in one job: the case number is part of every key."""
    rng = random.Random(7)
    existing, new, want = [], [], []
    for case in range(150):
        old_rows, new_rows = random_rows(rng, rng.randint(0, 5), 0), random_rows(rng, rng.randint(0, 6), 100)

        def tag(rows):
            return [
                (r[0] + case * 1000, f"{r[1]}-{case}" if r[1] else "", f"{r[2]}-{case}" if r[2] else "", *r[3:])
                for r in rows
            ]

        old_rows, new_rows = tag(old_rows), tag(new_rows)
        existing += old_rows
        new += new_rows
        want += fold(old_rows, new_rows, prune, compat)
    merged = merge.survivorship_merge(
        spark.createDataFrame(existing, SCHEMA), spark.createDataFrame(new, SCHEMA), prune=prune, compat=compat
    )
    got = sorted(tuple(str(r[c]) for c in COLUMNS) for r in merged.collect())
    assert got == sorted(want)


def directory(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def test_merge_cases(spark):
    old = directory(spark, ("1", "Old", "555", "Mon", 3.0, "d0"), ("", "Bar A", "1", "Tue", None, "d0"), ("", "Old Bar", None, None, None, "d0"))
    new = directory(
        spark, ("1", "New", "", "", 0.0, "d1"), ("2", "Bar A", "9", None, None, "d1"), ("3", "Bar A", "8", None, None, "d1"),
        ("", "Nameless", None, None, None, "d1"),
    )
    rows = {(r.place_id, r.restaurant_name): r for r in merge.survivorship_merge(old, new).collect()}
    one = rows["1", "New"]
    assert (one.phone_number, one.happy_hour_times, one.cheapest_drink_price, one.freshness_date) == ("", "Mon", 3.0, "d1")
    assert one.action == "updated" and not one.upgraded
    assert rows["2", "Bar A"].upgraded and rows["2", "Bar A"].happy_hour_times == "Tue"
    assert rows["3", "Bar A"].action == "added"
    assert rows["", "Old Bar"].action == "kept" and rows["", "Nameless"].action == "added"
    metrics = merge.merge_metrics(old, new).first()
    assert (metrics.updated, metrics.added, metrics.upgraded, metrics.total) == (2, 2, 1, 5)
    again = merge.survivorship_merge(old, directory(spark, ("1", "N", None, None, None, None)))
    assert again.filter("place_id = '1'").first().freshness_date is None
    folded = merge.survivorship_merge(old, new, compat=True).filter("restaurant_name = 'Bar A'").collect()
    assert [r.place_id for r in folded] == ["3"]


def test_merge_is_idempotent_for_unique_rows(spark):
    old = directory(spark, ("1", "A", "a", "x", 1.0, "d"), ("2", "B", None, None, None, "d"))
    new = directory(spark, ("2", "B2", "b", "y", 2.0, "e"), ("3", "C", "c", None, None, "e"))
    once = merge.survivorship_merge(old, new)
    base = once.select(F.col("position").alias("ord"), *COLUMNS)
    twice = merge.survivorship_merge(base, new)
    assert sorted(once.select(COLUMNS).collect()) == sorted(twice.select(COLUMNS).collect())


def test_output_order(spark):
    old = directory(spark, ("2", "B", None, None, None, "d"), ("", "L", None, None, None, "d"), ("1", "A", None, None, None, "d"), ("2", "B", "x", None, None, "d"))
    new = directory(spark, ("3", "C", None, None, None, "e"))
    rows = merge.survivorship_merge(old, new).orderBy("section", "appended", "position").collect()
    assert [(r.place_id, r.restaurant_name) for r in rows] == [("2", "B"), ("1", "A"), ("3", "C"), ("", "L")]


def test_hot_key_lookup_keeps_all_rows(spark):
    left = spark.range(3000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "").otherwise("P1").alias("place_id"), F.lit("N").alias("restaurant_name")
    )
    right = spark.createDataFrame([(0, "P1", "X", "a"), (1, "P1", "Y", "b"), (2, "", "N", "c")], "ord int, place_id string, restaurant_name string, v string")
    got = keyed.precedence_join(left, right, ["v"], seeds=["k"]).groupBy("hit.v").count().collect()
    assert {r.v: r["count"] for r in got} == {"b": 2000, "c": 1000}


def test_overrides(spark):
    places = spark.createDataFrame(
        [(0, "P1", "A", "own", "src", "d"), (1, "", "A", "own", "src", "d"), (2, "P2", "A", "own", "src", "d"), (3, None, "Z", "own", "src", "d")],
        "ord int, place_id string, restaurant_name string, happy_hour_times string, source string, freshness_date string",
    )
    rows = [(0, " P1 ", "Q", "by id", "", ""), (1, "P2", "R", "", "Manual", "e"), (2, "", "A", "by name", "Manual", "e"), (3, "P3", "", "x", "y", "z")]
    overrides = spark.createDataFrame(rows, "ord int, place_id string, restaurant_name string, happy_hour_times string, source string, freshness_date string")
    got = keyed.apply_overrides(places, overrides).orderBy("ord").collect()
    assert [(r.happy_hour_times, r.source, r.freshness_date) for r in got] == [
        ("by id", "Manual Override", "d"), ("by name", "Manual", "e"), ("own", "src", "d"), ("own", "src", "d"),
    ]


def test_backfill_status(spark):
    reference = spark.createDataFrame([(0, "P1", "A"), (1, "P2", " A "), (2, "P3", "B"), (3, "", "C")], "ord int, place_id string, restaurant_name string")
    rows = spark.createDataFrame([("", "A"), ("", " B"), ("", "C"), ("P9", "A"), ("", "")], "place_id string, restaurant_name string")
    got = {(r.restaurant_name, r.place_id, r.match_status) for r in keyed.key_backfill(rows, reference).collect()}
    assert got == {("A", "P1", "ambiguous"), (" B", "P3", "unique"), ("C", "", "none"), ("A", "P9", "kept"), ("", "", "none")}


def test_first_last_and_tiers(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), ("", 0, "w"), (None, 0, "w")], "k string, ord int, v string")
    assert {(r.k, r.v) for r in keyed.dedup_first(rows, "k", ["ord"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.k, r.v) for r in keyed.last_per_key(rows.filter("k <> ''"), ["k"], "ord").collect()} == {("a", "x"), ("b", "z")}
    late = spark.createDataFrame([("a", 0, "late"), ("c", 0, "late")], rows.schema)
    got = {(r.k, r.v, r.tier) for r in keyed.union_tiers(rows, late, key="k", order=["ord"]).collect()}
    assert got == {("a", "y", 0), ("b", "z", 0), ("c", "late", 1)}


def test_rank_limits_run_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("ord"))
    plan = keyed.first_per_key(rows, ["k"], ["ord"])._jdf.queryExecution().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_snapshots(spark):
    rows = [
        ("a", "2024-01-01 00:00:00", '{"v": 1}'), ("a", "2024-01-02 00:00:00", '{"v": 2}'), ("b", "2024-01-02 00:00:00", "{bad"),
        ("b", "2024-01-01 00:00:00", "{}"), ("c", "2023-11-01 00:00:00", "{}"), ("d", "2024-01-02 00:00:00", '{"v": 1}}'),
    ]
    frame = spark.createDataFrame(rows, "key string, cached_at string, payload string").withColumn("cached_at", F.to_timestamp("cached_at"))
    valid = incremental.ttl_latest(frame, "2024-01-10 00:00:00", 30)
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "key string")
    got = {r.key: r.payload for r in incremental.batch_lookup(keys, valid).collect()}
    assert got == {"a": '{"v": 2}', "b": None, "c": None, "d": None, "e": None}
    edge = frame.filter("key = 'a'")
    assert incremental.ttl_latest(edge, "2024-02-01 00:00:00", 30).count() == 1
    assert incremental.ttl_latest(edge, "2024-02-01 00:00:01", 30).count() == 0


def test_freshness(spark):
    rows = [("P1", "2024-03-01"), ("P2", "2024-02-01"), ("P3", "bad"), ("", "2024-03-09"), (None, "2024-03-09"), ("P4", "2024-02-30")]
    frame = spark.createDataFrame(rows, "place_id string, freshness_date string")
    fresh = incremental.fresh_ids(frame, "2024-03-10 12:00:00", 30)
    assert [r.place_id for r in fresh.collect()] == ["P1"]
    left = [r.place_id for r in incremental.skip_fresh(frame, fresh).collect()]
    assert sorted(map(str, left)) == ["", "None", "P2", "P3", "P4"]
    assert incremental.fresh_ids(frame, "2024-03-10", 0).count() == 0


def test_a_crowded_key_is_split_at_run_time(spark):
    """A third of the rows on one key, against a right side grouped by that key."""
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {name: spark.conf.get(name, None) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        key = F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit("P"), F.col("id")))
        left = spark.range(0, 200_000, 1, 16).select(key.alias("place_id"), F.col("id").alias("ord"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        right = keyed.dedup_first(left.select("place_id", "ord", F.lit("m").alias("m")), "place_id", ["ord"])
        joined = keyed.lookup(left, right, F.nullif(F.col("place_id"), F.lit("")), "place_id", "hit", ["ord"], ["m"])
        execution = joined._jdf.queryExecution()
        assert execution.toRdd().count() == 200_000
        assert "skew=true" in execution.executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def exchanges(frame):
    """Exchanges of the plan as it would be on tables too large to broadcast."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merge_moves_whole_rows_twice(spark):
    old = directory(spark, ("1", "N", None, None, None, None), ("", "Bar A", None, None, None, None))
    new = directory(spark, ("2", "Bar A", None, None, None, None))
    merged = merge.survivorship_merge(old, new)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert exchanges(merged) <= 9 and plan.count("SortAggregate") <= 6
    assert "Window" not in plan  # a target's rows combine before they are moved


def test_a_crowded_target_combines_before_the_shuffle(spark):
    """Twenty thousand new rows of one id arrive as one row a task."""
    from pyspark.sql import functions as F

    old = directory(spark, ("1", "N", None, None, None, None))
    columns = [c for c in old.columns if c != "ord"]
    values = {"place_id": F.lit("1"), "restaurant_name": F.lit("N")}
    new = spark.range(20_000, numPartitions=8).select(
        F.col("id").alias("ord"), *[values.get(c, F.col("id").cast(old.schema[c].dataType)).alias(c) for c in columns])
    row = merge.survivorship_merge(old, new).collect()
    assert len(row) == 1 and row[0].n_updates == 20_000 and row[0].action == "updated"


def test_figures_come_from_the_run_that_writes(spark, tmp_path):
    from pyspark.sql import Observation

    old = directory(spark, ("1", "N", None, None, None, None), ("2", "M", None, None, None, None), ("", "Bar A", None, None, None, None))
    new = directory(spark, ("1", "N", "t", None, None, None), ("3", "Bar A", None, None, None, None), ("4", "New", None, None, None, None))
    seen = Observation()
    merged = merge.observed_merge(old, new, seen, prune=True)
    merged.write.parquet(str(tmp_path / "merged"))
    assert seen.get == merge.merge_metrics(old, new, prune=True).first().asDict()
    assert spark.read.parquet(str(tmp_path / "merged")).count() == seen.get["total"] == 3 and seen.get["pruned"] == 1
