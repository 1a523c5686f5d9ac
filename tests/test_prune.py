"""Pages pruned by address in the scan: nothing wanted is lost, and raw HTML is not shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from wherewhen.operators import prune
from wherewhen.plans import extraction
from wherewhen.sources.documents import page_by_url


def exchanged(frame):
    """Inputs of every exchange of the plan."""
    text = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    return re.findall(r"^\(\d+\) (?:Broadcast)?Exchange.*\nInput \[\d+\]: \[(.*)\]", text, re.M)


def test_no_wanted_row_is_lost(spark):
    keys = spark.range(0, 30_000, 7).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    rows = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("x").alias("wide"))
    passed = {r.key for r in prune.likely_rows(rows, "key", prune.key_bitmap(keys, "key")).collect()}
    wanted = {r.key for r in keys.collect()}
    assert wanted <= passed and len(passed) < len(wanted) + 100
    assert prune.key_bitmap(keys, "key").count() <= prune.BITS // (1 << 15)


def test_no_keys_and_null_keys(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "key string, wide int")
    none = spark.createDataFrame([], "key string")
    assert prune.likely_rows(rows, "key", prune.key_bitmap(none, "key")).collect() == []
    some = spark.createDataFrame([("a",), (None,)], "key string")
    assert [r.wide for r in prune.likely_rows(rows, "key", prune.key_bitmap(some, "key")).collect()] == [1]


@pytest.fixture(scope="module")
def stored(spark):
    html = "<p>" + "Daily deal. " * 40 + '</p><a href="/menu/happy-hour">Happy hour</a>'
    rows = [(i, f"https://s{i}.com/", html) for i in range(50)]
    rows += [(None, "https://s1.com/only", "null id"), (None, "https://s2.com/", "older"), (3, "https://s3.com/", html)]
    rows += [(5, "https://s4.com/two", "a"), (5, "https://s4.com/two", "b"), (None, "https://s4.com/two", "c"), (9, None, "no address")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_without_an_id_are_found(spark, stored):
    asked = spark.createDataFrame([("https://s1.com/only",), ("https://s2.com/",), ("https://s3.com/",), ("https://s4.com/two",), ("https://no.com/",), (None,)], "url string")
    got = {r.url: r.html for r in page_by_url(stored, asked).collect()}
    assert got["https://s1.com/only"] == "null id" and got["https://s4.com/two"] == "b"
    assert got["https://s2.com/"].startswith("<p>") and got["https://s3.com/"].startswith("<p>")
    assert got["https://no.com/"] is None and got[None] is None and len(got) == 6
    assert sum("html" in e for e in exchanged(page_by_url(stored, asked))) <= 1


def test_prompts_shuffle_no_html(spark, stored):
    places = spark.createDataFrame([(i, f"Venue {i}", f"https://s{i}.com/", "") for i in range(0, 50, 5)], "k long, restaurant_name string, website_url string, happy_hour_times string")
    prompts = extraction.build_menu_prompts(places, stored, ["k"])
    assert prompts.count() == 10
    carried = exchanged(prompts)
    assert carried and not any(re.search(r"\bhtml#", e) for e in carried)


def test_only_sites_without_any_text_are_asked_by_images(spark):
    picture = '<img src="/menu.png">'
    rows = [
        ("https://a.com/", picture), ("https://b.com/", "<p>tiny</p>" + picture), ("https://c.com/specials", picture), ("https://c.com/", "<p>words</p>"),
        ("https://d.com/specials", picture + '<img src="/x.jpg">'), ("https://d.com/", ""), ("https://e.com/", '<img src="/logo.png">'),
        ("https://d.com/specials?again=1", '<img src="/never-menu.png">'), (None, picture),
    ]
    stored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    places = spark.createDataFrame(
        [(i, f"V {s}", f"https://{s}.com/" if s else None, " Monday: 1 - 2 PM ") for i, s in enumerate(["a", "b", "c", "d", "e", "f", "", "a"])],
        "k long, restaurant_name string, website_url string, happy_hour_times string")
    made = {r.k: r for r in extraction.build_menu_image_prompts(places, stored, ["k"]).collect()}
    assert {k: (r.page_url, r.images) for k, r in made.items()} == {
        0: ("https://a.com", ["https://a.com/menu.png"]), 7: ("https://a.com", ["https://a.com/menu.png"]),
        3: ("https://d.com/specials", ["https://d.com/menu.png", "https://d.com/x.jpg"]),
    }
    assert "V a" in made[0].prompt and "Known hours: Monday: 1 - 2 PM\n" in made[0].prompt
    one = extraction.build_menu_image_prompts(places, stored, ["k"], limit=1).where("k = 3").first()
    assert one.images == ["https://d.com/menu.png"]
    answers = spark.createDataFrame([(0, '{"happy_hours": [], "confidence": "none"}'), (1, "no answer"), (3, '{"happy_hours": [], "confidence": "high"}')], "k long, response string")
    asked = {r.k: r.images for r in extraction.build_hours_image_prompts(places, stored, ["k"], answers).collect()}
    assert asked == {0: ["https://a.com/menu.png"], 1: ["https://b.com/menu.png"], 2: ["https://c.com/menu.png"], 7: ["https://a.com/menu.png"]}
