"""Menu CSV lines in two layouts.

The keyed layout has seven columns and starts with a place id; the older one
has six and no id. Files may mix them, so the layout is decided per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled, lenient_double, trim_space
from ..operators.items import number_text, option_summary

# How the ids of the keyed layout begin, and its header.
ID_PREFIX = "ChIJ"
HEADER = [
    "place_id", "restaurant_name", "cheapest_drink", "cheapest_drink_price", "cheapest_food",
    "cheapest_food_price", "cheapest_options_summary",
]
_VALUES = HEADER[1:6]
_CSV = {"quote": '"', "escape": '"'}


def _fields(line: Column, names: list[str]) -> Column:
    return F.from_csv(line, ", ".join(f"{n} string" for n in names), _CSV)


def _width(line: Column) -> Column:
    """Number of fields: commas outside quotes, plus one."""
    return F.length(F.regexp_replace(F.regexp_replace(line, '"[^"]*"', ""), "[^,]", "")) + 1


def parse_menu_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One typed row per line; header and empty lines are skipped."""
    line = F.col(column)
    first = F.regexp_replace(F.regexp_extract(line, r"^\s*(\"[^\"]*\"|[^,]*)", 1), '"', "")
    keyed = (_width(line) >= 7) & F.startswith(trim_space(first), F.lit(ID_PREFIX))
    rows = lines.filter(filled(trim_space(line)) & (line != ",".join(HEADER)))
    # Fields beyond the named ones are dropped by the parser.
    rows = rows.withColumn(
        "row",
        F.when(keyed, F.struct(
            F.lit(True).alias("keyed"), _fields(line, HEADER).alias("new"), F.lit(None).cast(_old_type()).alias("old")
        )).otherwise(F.struct(
            F.lit(False).alias("keyed"), F.lit(None).cast(_new_type()).alias("new"),
            _fields(line, [*_VALUES, "cheapest_options_summary"]).alias("old"),
        )),
    )

    def value(name: str) -> Column:
        chosen = F.when(F.col("row.keyed"), F.col(f"row.new.{name}")).otherwise(F.col(f"row.old.{name}"))
        text = F.coalesce(trim_space(chosen), F.lit(""))
        return (lenient_double(text) if name.endswith("_price") else text).alias(name)

    return rows.select(
        F.coalesce(trim_space(F.col("row.new.place_id")), F.lit("")).alias("place_id"),
        *[value(n) for n in _VALUES],
    )


def _new_type() -> str:
    return "struct<" + ", ".join(f"{n}: string" for n in HEADER) + ">"


def _old_type() -> str:
    return "struct<" + ", ".join(f"{n}: string" for n in [*_VALUES, "cheapest_options_summary"]) + ">"


def read_menu_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_menu_lines(spark.read.text(path))


def menu_lines(rows: DataFrame) -> DataFrame:
    """Rows ready for the keyed layout, with the generated summary of all options."""
    def price(name: str) -> Column:
        return F.coalesce(number_text(F.col(name)), F.lit("")).alias(name)

    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    return rows.select(
        text("place_id"), text("restaurant_name"), text("cheapest_drink"), price("cheapest_drink_price"),
        text("cheapest_food"), price("cheapest_food_price"),
        option_summary(F.col("all_food_options"), F.col("all_drink_options")).alias("cheapest_options_summary"),
    )


def write_menu_lines(rows: DataFrame, path: str) -> None:
    menu_lines(rows).write.mode("overwrite").csv(path, header=True, emptyValue="", **_CSV)
