"""Schedules parsed once: against the reading row by row, and against brute force at many instants."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wherewhen.functions import schedule
from wherewhen.operators import schedule as jobs
from wherewhen.operators import sessions

ODD = [
    "", None, "   ", "Sunday: 3 - 6 PM", "sunday:3 - 6 PM", "Sunday:", "Sunday: ", "Sunday:\n", "Sunday:\n ", "Sunday: 3 - 6 PM\n", ": 3 - 6 PM",
    "Sunday:\n3 - 6 PM", "Sunday: 3 - 6\nPM", "Sunday: 10 PM - 2 AM, 1 - 3 AM | Sunday: 11 PM - 1 AM", "Monday: Closed | Monday: 1 - 2 PM",
    "Call us | Friday: 9 pm - Close", "Tuesday: 3pm-6pm", "Wednesday: 15:00 - 15:00", "Noday: 1 - 2 PM", "Thursday: 11:30 AM - 12 PMFriday: 4 - 6 pm",
    "Saturday: a - b - c, 4 - 5 PM", "Saturday: 12:00 AM - 11:59 PM",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    texts = list(ODD)
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a, b = rng.randint(1, 12), rng.randint(1, 12)
            parts.append(f"{rng.choice(schedule.DAYS)}: {a}:{rng.choice(['00', '30'])} {rng.choice(['AM', 'PM'])} - {b} {rng.choice(['AM', 'PM'])}")
        texts.append(" | ".join(parts))
    crowd = texts[30]
    return [(i, t) for i, t in enumerate(texts + [crowd] * 300)]


@pytest.fixture(scope="module")
def places(spark, rows):
    return spark.createDataFrame(rows, "k long, happy_hour_times string")


@pytest.mark.parametrize("carry", [False, True])
def test_once_parsed_equals_row_by_row(places, carry):
    for at in ("2026-04-19 16:00:00", "2026-04-19 00:30:00", "2026-04-20 01:10:00", "2026-04-24 23:59:00"):
        day, minute = jobs.instant_parts(at)
        want = places.where(schedule.is_active(F.col("happy_hour_times"), day, minute, carry)).select("k").collect()
        got = jobs.active_at(places, at, carry_to_next_day=carry).select("k").collect()
        assert sorted(got) == sorted(want)


def test_status_and_display_once_per_text(places):
    day, minute = jobs.instant_parts("2026-04-19 16:00:00")
    c = F.col("happy_hour_times")
    want = places.select("k", schedule.status_code(c, day, minute), schedule.normalized_schedule(c)).collect()
    status = jobs.status_at(places, "2026-04-19 16:00:00")
    got = jobs.schedule_normalize(status).select("k", "status", "schedule_text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_session_rows_equal_the_array_reading(places):
    c = F.col("happy_hour_times")
    entries = places.select("k", F.explode(schedule.flexible_entries(c)).alias("e")).where("e.body <> ''").select("k", "e.*")
    want = entries.where("NOT closed").select("k", "entry_ord", "day_raw", "day_idx", F.explode(schedule.flexible_sessions(F.col("body"))).alias("s")).where(
        "s.usable").selectExpr("k", "entry_ord", "day_raw", "day_idx", "s.session_ord", "s.start_txt", "s.end_txt", "s.start_min", "s.end_min")
    got = jobs.schedule_explode(places, ["k"])
    same = got.where("NOT closed").select("k", "entry_ord", "day_raw", "day_idx", "session_ord", "start_txt", "end_txt", "start_min0", "end_min0")
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, same.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.where("closed").count() == entries.where("closed").count()


def brute(places, minutes):
    """(weekday, minute) -> active keys, from the sessions as rows."""
    held = defaultdict(list)
    for r in jobs.schedule_explode(places, ["k"]).where("NOT closed AND day_idx IS NOT NULL").collect():
        held[r.day_idx].append((r.k, r.start_min0, r.end_min0))
    return {
        (d, m): {k for k, a, b in held[d] if (m >= a or m <= b if b < a else a <= m <= b)} for d, m in minutes
    }


def test_ten_thousand_instants(spark, places, tmp_path):
    rng = random.Random(2)
    start = datetime(2026, 4, 19)
    moments = [(i, start + timedelta(minutes=rng.randrange(30_000), seconds=rng.randrange(60))) for i in range(10_000)] + [(-1, None)]
    instants = spark.createDataFrame(moments, "i long, at timestamp_ntz")
    minute = {i: (at.isoweekday() % 7, at.hour * 60 + at.minute) for i, at in moments if at}
    want = brute(places, set(minute.values()))
    sessions.write_sessions(places, str(tmp_path / "s"))
    stored = sessions.read_sessions(spark, str(tmp_path / "s"))
    for held in (None, stored):
        got = sessions.active_sweep(places, instants, "at", "k", sessions=held).collect()
        assert len(got) == len(moments)
        for r in got:
            active = want[minute[r.i]] if r.i in minute else set()
            assert (r.n_active, r.first_active) == (len(active), min(active, default=None))
    some = instants.where("i BETWEEN 0 AND 40")
    for held in (None, stored):
        pairs = sessions.active_pairs(places, some, "at", ["k"], sessions=held)
        assert sorted((r.i, r.k) for r in pairs.collect()) == sorted((i, k) for i in range(41) for k in want[minute[i]])
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "dynamicpruning" in plan  # stored sessions of weekdays that nobody asks for are not read


def test_one_question_reads_one_weekday(spark, places, tmp_path):
    sessions.write_sessions(places, str(tmp_path / "s"))
    stored = sessions.read_sessions(spark, str(tmp_path / "s"))
    at = "2026-04-24 17:00:00"
    found = sessions.active_places(places, at, stored)
    assert sorted(found.collect()) == sorted(jobs.active_at(places, at).collect())
    read = sessions.active_texts(stored, at)
    assert "PartitionFilters: [isnotnull(day_idx" in read._jdf.queryExecution().executedPlan().toString()
    assert {f.split("day_idx=")[1].split("/")[0] for f in stored.where("day_idx = 5").inputFiles()} >= {"5"}


def test_a_crowded_text_is_split(spark, places):
    """Both sides of the join with the dictionary exchange for it, so Spark can split a text's rows."""
    frame = jobs.schedule_normalize(places)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin"):]
    assert join.count("ENSURE_REQUIREMENTS") >= 3


def test_no_places(spark):
    empty = spark.createDataFrame([], "k long, happy_hour_times string")
    instants = spark.createDataFrame([(1, datetime(2026, 4, 19, 16))], "i long, at timestamp_ntz")
    assert [tuple(r) for r in sessions.active_sweep(empty, instants, "at", "k").select("i", "n_active", "first_active").collect()] == [(1, 0, None)]
    assert sessions.active_pairs(empty, instants, "at", ["k"]).collect() == []
