"""Readers, writers and the streaming merge."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wherewhen import schema
from wherewhen.operators.documents import flatten_places
from wherewhen.operators.items import menu_rows
from wherewhen.plans.refresh import enrich, refresh
from wherewhen.sources import documents, menu_files, tables
from wherewhen.streaming import upsert


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_places(spark, tmp_path):
    path = write(tmp_path / "p.csv", (
        "extra,address,restaurant_name,cheapest_drink_price,place_id,cheapest_food_price,happy_hour_times\n"
        'x,"1 Main, Suite 2","Joe ""J"" Bar",5.5,P1,N/A,"Monday: 3 PM\n- 6 PM"\nx,,B,,,1d,\n'
    ))
    frame = tables.read_places(spark, path, multi_line=True)
    assert frame.columns == schema.PLACES.fieldNames()
    one, two = frame.orderBy("restaurant_name").collect()[::-1]
    assert (one.restaurant_name, one.address, one.cheapest_drink_price, one.cheapest_food_price) == ('Joe "J" Bar', "1 Main, Suite 2", 5.5, None)
    assert "\n" in one.happy_hour_times and one.phone_number == "" and one.latitude is None
    assert (two.address, two.place_id, two.cheapest_drink_price, two.cheapest_food_price) == (None, None, None, None)


def test_missing_files_are_empty(spark, tmp_path):
    assert tables.read_menu(spark, str(tmp_path / "none.csv")).count() == 0
    assert tables.read_text_table(spark, str(tmp_path / "none.csv")) is None


def test_overrides_are_trimmed_and_texts_keep_blanks(spark, tmp_path):
    path = write(tmp_path / "o.csv", "place_id,restaurant_name,happy_hour_times\n P1 , Bar ,\n")
    row = tables.read_overrides(spark, path).first()
    assert tuple(row) == ("P1", "Bar", "", "", "")
    assert tuple(tables.read_text_table(spark, path).first()) == (" P1 ", " Bar ", "")


def test_write_table(spark, tmp_path):
    frame = spark.createDataFrame([("A", 0.0, None), ('B, "x"', 2.5, "")], "restaurant_name string, cheapest_drink_price double, menu_url string")
    out = str(tmp_path / "out")
    assert tables.write_table(frame, out, ["cheapest_drink_price", "restaurant_name", "menu_url"])
    back = {r.restaurant_name: r for r in tables.read_menu(spark, out).collect()}
    assert back["A"].cheapest_drink_price == 0.0 and back['B, "x"'].menu_url is None
    assert not tables.write_table(frame.limit(0), out) and tables.read_menu(spark, out).count() == 2
    tables.write_table(frame, out, zero_is_blank=True)
    assert {r.cheapest_drink_price for r in tables.read_menu(spark, out).collect()} == {None, 2.5}
    with pytest.raises(AnalysisException):
        tables.write_table(frame, out, ["nope"])
    export = tables.menu_export(tables.read_places(spark, str(tmp_path / "none")).unionByName(
        spark.createDataFrame([("A", None, "s")], "restaurant_name string, cheapest_drink string, menu_summary string"), allowMissingColumns=True))
    assert [tuple(r) for r in export.collect()] == [("", "A", "", "", "", "", "s", "")]


def test_place_documents(spark, tmp_path):
    docs = [
        {"id": "1", "displayName": {"text": "Joe"}, "rating": 4, "userRatingCount": 0, "location": {"latitude": 32.7, "longitude": -117.1},
         "regularOpeningHours": {"weekdayDescriptions": ["Mon", "Tue"]}, "types": ["bar"], "ignored": {"x": 1},
         "currentSecondaryOpeningHours": [{"secondaryHoursType": "DELIVERY", "weekdayDescriptions": ["no"]},
                                          {"secondaryHoursType": "happy_hour", "weekdayDescriptions": ["Monday: 3 PM", "Tuesday: 4 PM"]}]},
        {"id": "2", "rating": 4.5, "currentSecondaryOpeningHours": [{"secondaryHoursType": "HAPPY_HOUR"}]},
    ]
    path = write(tmp_path / "d.json", "\n".join(json.dumps(d) for d in docs))
    rows = {r.place_id: r for r in flatten_places(documents.read_place_documents(spark, path)).collect()}
    one, two = rows["1"], rows["2"]
    assert (one.restaurant_name, one.rating, one.review_count, one.latitude, one.regular_hours) == ("Joe", "4", "", "32.7", "Mon | Tue")
    assert one.happy_hour_times == "Monday: 3 PM | Tuesday: 4 PM" and one.source == "Google Places API (Happy Hours)"
    assert (two.restaurant_name, two.rating, two.happy_hour_times, two.source, two.latitude) == ("", "4.5", "", "Google Places API", "")
    assert flatten_places(documents.read_place_documents(spark, path)).columns == schema.PLACES.fieldNames()


def test_field_mask_reaches_the_reader(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(3).select(F.col("id").cast("string"), F.lit("x").alias("other"), F.struct(F.lit("n").alias("text"), F.lit("en").alias("languageCode")).alias("displayName")).write.parquet(path)
    plan = spark.read.parquet(path).select("displayName.text")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<displayName:struct<text:string>>" in plan


def test_menu_lines(spark, tmp_path):
    lines = ["ChIJx,Bar,Lager,5,Wings,6.5x,sum", 'Bar B,"Ale, dark",,Fries,3,sum', "", ",".join(menu_files.HEADER), " ChIJy , Bar ,,,,"]
    rows = menu_files.read_menu_lines(spark, write(tmp_path / "m.csv", "\n".join(lines))).collect()
    assert sorted(tuple(r) for r in rows) == sorted([
        ("ChIJx", "Bar", "Lager", 5.0, "Wings", 6.5), ("", "Bar B", "Ale, dark", None, "Fries", 3.0), ("", "ChIJy", "Bar", None, "", None),
    ])


def test_menu_lines_round_trip(spark, tmp_path):
    answers = spark.createDataFrame(
        [("ChIJ1", "Bar, One", ("Lager", 5.0), ("Wings", 1.5)), ("ChIJ2", "Two", None, None)],
        "place_id string, restaurant_name string, drink struct<name: string, price: double>, food struct<name: string, price: double>",
    )
    rows = menu_rows(answers)
    lines = {r.place_id: r for r in menu_files.menu_lines(rows).collect()}
    assert lines["ChIJ1"].cheapest_options_summary == "$1.5 Wings and $5 Lager" and lines["ChIJ1"].cheapest_drink_price == "5"
    assert lines["ChIJ2"].cheapest_options_summary == ""
    menu_files.write_menu_lines(rows, str(tmp_path / "out"))
    back = {r.place_id: r for r in menu_files.read_menu_lines(spark, str(tmp_path / "out")).collect()}
    assert back["ChIJ1"].restaurant_name == "Bar, One" and back["ChIJ1"].cheapest_food_price == 1.5
    assert back["ChIJ2"].cheapest_drink == ""


ROW = "ord long, place_id string, restaurant_name string, happy_hour_times string, freshness_date string"


def test_stream_refresh(spark, tmp_path):
    root, source = str(tmp_path / "table"), str(tmp_path / "in")
    start = spark.createDataFrame([(0, "P1", "A", "Mon", "d0"), (1, "", "B", "Tue", "d0")], ROW)
    upsert.write_version(start, root, 0)

    def arrive(*rows):
        spark.createDataFrame(list(rows), ROW).coalesce(1).write.mode("append").parquet(source)
        upsert.stream_refresh(spark, source, start.schema, root, str(tmp_path / "ckpt")).awaitTermination()

    arrive((0, "P1", "A2", "", "d1"), (1, "P2", "B", None, "d1"))
    arrive((0, "P3", "C", "Fri", "d2"))
    last = upsert.latest_version(spark, root)
    rows = {r.place_id: r for r in upsert.read_version(spark, root, last).collect()}
    assert last == 2 and set(rows) == {"P1", "P2", "P3"}
    assert (rows["P1"].restaurant_name, rows["P1"].happy_hour_times) == ("A2", "Mon")
    assert (rows["P2"].happy_hour_times, rows["P2"].freshness_date) == ("Tue", "d1")
    assert len({r.ord for r in rows.values()}) == 3
    upsert.merge_batch(start.limit(0), 1, root)  # a repeated batch is written again
    with pytest.raises(ValueError, match="checkpoint"):
        upsert.merge_batch(start, 0, root)


def places_frame(spark, *rows):
    base = spark.createDataFrame([], schema.PLACES)
    names = ["ord", "place_id", "restaurant_name", "happy_hour_times", "freshness_date", "latitude", "longitude"]
    some = spark.createDataFrame(list(rows), "ord long, place_id string, restaurant_name string, happy_hour_times string, freshness_date string, latitude string, longitude string")
    assert some.columns == names
    return base.unionByName(some, allowMissingColumns=True).withColumn("ord", F.col("ord"))


def test_refresh(spark):
    existing = places_frame(
        spark, (0, "P1", "Old", "Mon", "2024-01-01", None, None), (1, "P2", "Fresh", "Tue", "2024-03-09", None, None),
        (2, "P3", "Gone", "Wed", "2024-01-01", None, None), (3, "", "Legacy", "Thu", "2024-01-01", None, None),
    )
    hits = spark.createDataFrame([(0, 0, 0, "P1"), (0, 0, 1, "P2"), (1, 0, 0, "P1"), (1, 0, 1, "P4"), (1, 0, 2, "P5"), (1, 0, 3, "P6")], "keyword_ord int, page int, pos int, place_id string")
    docs = spark.createDataFrame(
        [("P1", ("New", "en"), ["bar"]), ("P2", ("Changed", "en"), ["bar"]), ("P4", ("Cafe", "en"), ["cafe"]), ("P5", ("Legacy", "en"), ["bar"]), ("P6", ("Legacy", "en"), None)],
        "id string, displayName struct<text: string, languageCode: string>, types array<string>",
    )
    full = spark.createDataFrame([], schema.PLACE_DOCUMENT).unionByName(docs, allowMissingColumns=True)
    rows = {r.place_id: r for r in refresh(existing, hits, full, "2024-03-10 12:00:00").collect()}
    assert set(rows) == {"P1", "P2", "P3", "P5", "P6"}
    assert (rows["P1"].restaurant_name, rows["P1"].happy_hour_times, rows["P1"].freshness_date) == ("New", "Mon", "2024-03-10")
    assert (rows["P2"].restaurant_name, rows["P2"].freshness_date) == ("Fresh", "2024-03-09")
    assert rows["P5"].upgraded and rows["P5"].happy_hour_times == "Thu" and rows["P6"].action == "added"
    all_again = {r.place_id for r in refresh(existing, hits, full, "2024-03-10", stale_days=0).collect()}
    assert all_again == {"P1", "P2", "P5", "P6"}


def test_enrich(spark):
    places = places_frame(spark, (0, "P1", "A", "Mon", "d", "32.75", "-117.12abc"), (1, "", "B", "Tue", "d", "", "x"))
    overrides = spark.createDataFrame([(0, "", "B", "Fri", "", "")], "ord int, place_id string, restaurant_name string, happy_hour_times string, source string, freshness_date string")
    menu = spark.createDataFrame([(0, "P1", "Z", "Ale", "5x", "", "", "s", "")], "ord int, place_id string, restaurant_name string, cheapest_drink string, cheapest_drink_price string, cheapest_food string, cheapest_food_price string, menu_summary string, menu_url string")
    one, two = enrich(places, overrides, menu).orderBy("ord").collect()
    assert (one.neighborhood, one.cheapest_drink, one.cheapest_drink_price, one.cheapest_food) == ("north_park", "Ale", 5.0, None)
    assert (two.neighborhood, two.happy_hour_times, two.source) == (None, "Fri", "Manual Override")


def test_written_rows_are_counted_by_the_run_that_makes_them(spark, tmp_path):
    """The plan runs once, however many rows there are."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(1000, numPartitions=4).selectExpr("string(id) AS restaurant_name").mapInArrow(touch, "restaurant_name string")
    assert tables.write_table(frame, str(tmp_path / "t")) == 1000 and seen.value == 1000
    assert tables.write_table(frame.where("restaurant_name = 'x'"), str(tmp_path / "t")) == 0
    assert tables.read_text_table(spark, str(tmp_path / "t")).count() == 1000


def test_a_plain_file_is_read_in_several_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("restaurant_name,place_id\n" + "".join(f"Venue {i},P{i}\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = tables.read_menu(spark, str(path))
        assert rows.rdd.getNumPartitions() >= 4 and rows.where("place_id = 'P59999'").count() == 1
        whole = tables.read_menu(spark, str(path), multi_line=True)
        assert whole.rdd.getNumPartitions() == 1 and whole.count() == rows.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
