"""Clock texts and weekly schedules."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wherewhen.functions import clock, schedule
from wherewhen.operators import schedule as jobs

SUNDAY, MONDAY, SATURDAY = "2026-04-19", "2026-04-20", "2026-04-18"
NARROW, EN = " ", "–"


def test_canonical_clock(evaluate):
    cases = {
        "3:00 pm": "3:00 PM", "3pm": "3:00 PM", "3 pm": "3:00 PM", "3:00PM": "3:00 PM", "3:00  PM": "3:00 PM",
        "3 p.m.": "3:00 PM", "4:30AM": "4:30 AM", "12am": "12:00 AM", "12pm": "12:00 PM", "15:00": "3:00 PM",
        "09:30": "9:30 AM", "00:00": "12:00 AM", "23:59": "11:59 PM", "24:00": "24:00", "3:00": "3:00 AM",
        "Close": "Close", f"3:00{NARROW}PM": "3:00 PM", "": "", "3:00 PM sharp": "3:00 PM",
    }
    assert evaluate(clock.canonical_clock, list(cases)) == list(cases.values())


def test_minutes(evaluate):
    cases = {
        "3:00 pm": 900, "3pm": 900, "4:30AM": 270, "12am": 0, "12pm": 720, "15:00": 900, "09:30": 570, "00:00": 0,
        "23:59": 1439, "12:30 AM": 30, "10:45 PM": 1365, "Close": 0, "3 p.m.": 900, "3": 0, "24:00": 0,
        "from 3:00 PM": 900, "1;2;3": 0, "99999999999:00 PM": 0, "3:00　PM": 900,
    }
    assert evaluate(clock.flexible_minutes, list(cases)) == list(cases.values())
    slow = evaluate(lambda c: clock.clock_minutes_or_zero(clock.canonical_clock(c)), list(cases))
    assert slow == list(cases.values())
    assert evaluate(clock.clock_minutes, ["3:00 PM", "Close", "3pm", None]) == [900, None, None, None]


def test_normalized_schedule(evaluate):
    cases = {
        "Friday: 2 - 7:00 PM": "Friday: 2:00 PM - 7:00 PM",
        "Sunday: 9 - 11 AM": "Sunday: 9:00 AM - 11:00 AM",
        "Monday: 10:00 AM - 2:00 PM": "Monday: 10:00 AM - 2:00 PM",
        "<p>Monday: 3:00 PM - 6:00 PM</p>": "",
        f"Monday: 3:00 PM{EN}6:00 PM": "Monday: 3:00 PM - 6:00 PM",
        f"Monday:{NARROW}3:00{NARROW}PM{NARROW}{EN}{NARROW}6:00{NARROW}PM": "Monday: 3:00 PM - 6:00 PM",
        "Monday: 3:00 PM –​6:00 PM": "Monday: 3:00 PM - 6:00 PM",
        "Monday: 3pm-6pm": "Monday: 3:00 PM - 6:00 PM",
        "Monday: 4 - 6 pmTuesday: CLOSED": "Monday: 4:00 PM - 6:00 PM | Tuesday: Closed",
        "Call us": "Call us", "   ": "", "": "", "Monday: noon": "Monday: noon",
        "Monday: 3 - 4 PM, 9 - 11 PM": "Monday: 3:00 PM - 4:00 PM, 9:00 PM - 11:00 PM",
    }
    assert evaluate(schedule.normalized_schedule, list(cases)) == list(cases.values())


def test_strict_entries(evaluate):
    texts = [
        "Monday: 3:00 - 6:00 PM", "Monday: 3:00 PM - 6:00 PM | Tuesday: 4:00 PM - 7:00 PM", "Monday: Closed", "",
        "Monday: 3:00 - 6:00 PM, 10:00 - 11:00 PM", "Monday: 4 - 6 pmTuesday: 4 - 6 pmWednesday: 4 - 6 pm",
        "Monday: 3pm-6pm", "Monday: late, 4:00 PM - 5:00 PM",
    ]
    got = [[tuple(e)[1:] for e in row] for row in evaluate(schedule.strict_entries, texts)]
    assert got[0] == [("Monday", "3:00", "6:00 PM", False, "", "")]
    assert [e[0] for e in got[1]] == ["Monday", "Tuesday"]
    assert got[2] == [("Monday", "", "", False, "", "")]
    assert got[3] == []
    assert got[4] == [("Monday", "3:00", "6:00 PM", True, "10:00", "11:00 PM")]
    assert len(got[5]) == 3
    assert got[6] == [] and got[7] == []


ACTIVE_CASES = [
    (SUNDAY, 16, 0, "Sunday: 3:00 PM - 6:00 PM", True, "ACTIVE"),
    (SUNDAY, 10, 0, "Sunday: 3:00 PM - 6:00 PM", False, "LATER_TODAY"),
    (SUNDAY, 19, 0, "Sunday: 3:00 PM - 6:00 PM", False, "PASSED_TODAY"),
    (MONDAY, 16, 0, "Tuesday: 3:00 PM - 6:00 PM", False, "NO_HAPPY_HOUR_TODAY"),
    (SUNDAY, 16, 0, "Sunday: Closed | Monday: 3:00 PM - 6:00 PM", False, "CLOSED_TODAY"),
    (SUNDAY, 16, 0, "", False, "NO_HAPPY_HOUR"),
    (SUNDAY, 16, 0, "   ", False, "NO_HAPPY_HOUR"),
    (SUNDAY, 16, 0, None, False, "NO_HAPPY_HOUR"),
    (SUNDAY, 23, 59, "Sunday: 10:00 PM - 12:00 AM", True, "ACTIVE"),
    (MONDAY, 1, 0, "Sunday: 10:00 PM - 12:00 AM | Monday: Closed", False, "CLOSED_TODAY"),
    (SUNDAY, 22, 0, "Sunday: 3:00 PM - 6:00 PM, 9:00 PM - 11:00 PM", True, "ACTIVE"),
    (SUNDAY, 19, 0, "Sunday: 3:00 PM - 6:00 PM, 9:00 PM - 11:00 PM", False, "PASSED_TODAY"),
    (SUNDAY, 16, 0, "sunday: 3:00 PM - 6:00 PM", True, "ACTIVE"),
    (SUNDAY, 16, 0, "Sunday: 3 - 6 PM", True, "ACTIVE"),
    (SUNDAY, 23, 0, "Sunday: 10:00 - 12:00 AM", True, "ACTIVE"),
    (MONDAY, 17, 0, "Monday: 4 - 6 pmTuesday: 4 - 6 pm", True, "ACTIVE"),
    (SATURDAY, 22, 30, "Friday: 9 PM - 11 PM Saturday: 9 PM - 11 PM", False, "NO_HAPPY_HOUR_TODAY"),
    (MONDAY, 16, 0, "Monday: 3pm-6pm", False, "NO_HAPPY_HOUR_TODAY"),
    (MONDAY, 1, 0, "Monday: 3 - 6 p.m.", True, "ACTIVE"),
    (MONDAY, 20, 0, "Monday: 4:00 PM - Close", True, "ACTIVE"),
    (MONDAY, 12, 0, "Sunday: Closed", False, "NO_HAPPY_HOUR"),
    (SUNDAY, 16, 0, "Sunday: | Monday: 3 - 6 PM", False, "NO_HAPPY_HOUR_TODAY"),
]


def test_active_and_status(spark):
    rows = [(i, f"{d} {h:02d}:{m:02d}:00", t) for i, (d, h, m, t, _, _) in enumerate(ACTIVE_CASES)]
    frame = spark.createDataFrame(rows, "i int, at string, happy_hour_times string")
    at = F.to_timestamp_ntz("at")
    day, minute = jobs.instant_parts(at)
    got = frame.select(
        "i", jobs.active_column("happy_hour_times", at).alias("active"),
        schedule.status_code(F.col("happy_hour_times"), day, minute).alias("status"),
    ).orderBy("i").collect()
    assert [(r.active, r.status) for r in got] == [(a, s) for *_, a, s in ACTIVE_CASES]
    assert all(r.status == "ACTIVE" for r in got if r.active)


def test_strict_differs_from_flexible(evaluate):
    day, minute = F.lit(1), F.lit(960)
    texts = ["Monday: 3:00 - 6:00 PM", "Monday: 3:00 PM - 6:00 PM", "monday: 3:00 PM - 6:00 PM", "Monday: 3pm-6pm"]
    assert evaluate(lambda c: schedule.is_active(c, day, minute), texts) == [True, True, True, False]
    assert evaluate(lambda c: schedule.is_active_strict(c, day, minute), texts) == [False, True, False, False]


def test_carry_to_next_day(evaluate):
    texts = ["Saturday: 9:00 PM - 1:00 AM", "Sunday: 9:00 PM - 1:00 AM"]
    day, minute = F.lit(0), F.lit(30)
    assert evaluate(lambda c: schedule.is_active(c, day, minute), texts) == [False, True]
    assert evaluate(lambda c: schedule.is_active(c, day, minute, True), texts) == [True, False]


def test_rendered_and_day_texts(evaluate):
    texts = ["", "Monday: 3 - 6 PM, 9 - 10 PM | Tuesday: Closed", "whenever"]
    assert evaluate(schedule.rendered_schedule, texts) == [
        "No happy hour info", "Monday: 3 - 6 PM, 9 - 10 PM | Tuesday: Closed", "whenever",
    ]
    assert evaluate(lambda c: schedule.day_schedule(c, F.lit(1)), texts) == ["", "3 - 6 PM, 9 - 10 PM", ""]
    assert evaluate(lambda c: schedule.day_schedule(c, F.lit(2)), texts) == ["", "", ""]
    assert evaluate(lambda c: schedule.display_line(c, F.lit(2)), texts) == ["", "Tuesday: Closed", ""]


def test_instants():
    today = date(2026, 4, 22)  # a Wednesday
    assert jobs.instant_for("Sunday", 16, today) == datetime(2026, 4, 19, 16)
    assert jobs.instant_for("Saturday", 0, today) == datetime(2026, 4, 25, 0)
    with pytest.raises(ValueError):
        jobs.active_column("happy_hour_times", SUNDAY, mode="other")


def test_schedule_from_items(spark):
    frame = spark.sql(
        "select array(named_struct('day','Monday','times','3 - 6 PM'), named_struct('day','','times','x'), "
        "named_struct('day','Friday','times','4 PM')) as items"
    )
    assert frame.select(schedule.schedule_from_items(F.col("items"))).first()[0] == "Monday: 3 - 6 PM | Friday: 4 PM"


def test_occupancy_counts_a_place_once_per_hour(spark):
    frame = spark.createDataFrame(
        [("Sunday: 3 - 5 PM, 4 - 6 PM",), ("Sunday: 11:00 PM - 12:00 AM",)], "happy_hour_times string"
    )
    got = {(r.day_idx, r.hour): r.n_active for r in jobs.weekly_occupancy(frame).collect()}
    assert got == {(0, 15): 1, (0, 16): 1, (0, 17): 1, (0, 18): 1, (0, 23): 1, (0, 0): 1}
