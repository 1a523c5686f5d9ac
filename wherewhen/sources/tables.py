"""CSV tables of the directory. Parquet is the native form for large ones.

CSV is read with header names: a schema would bind by position and shift
silently when a file has other columns. Blank cells are NULL.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strict_double, trim_space
from ..schema import MENU, MENU_NULL_WHEN_ABSENT, OVERRIDES, PLACES, PLACES_NULL_WHEN_ABSENT
from ..session import stored

# What the menu export writes, in order.
MENU_EXPORT = [
    "place_id", "restaurant_name", "cheapest_drink", "cheapest_drink_price", "cheapest_food",
    "cheapest_food_price", "menu_summary", "menu_url",
]


def _read(spark: SparkSession, path: str, multi_line: bool, **options) -> DataFrame | None:
    try:
        return spark.read.csv(
            path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"', **options
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_typed(
    spark: SparkSession, path: str, schema: T.StructType, null_when_absent: set[str] = frozenset(),
    multi_line: bool = False,
) -> DataFrame:
    """Exactly the schema's columns, by name; a missing file is an empty table.

    Other columns are dropped, a column the file lacks is empty text (or NULL
    where listed), and a number that cannot be read is NULL. A file is read in
    several splits; cells with line breaks in quotes need ``multi_line``, which
    reads each file in one task.
    """
    raw = _read(spark, path, multi_line)
    if raw is None:
        return spark.createDataFrame([], schema)

    def column(field: T.StructField) -> Column:
        if field.name not in raw.columns:
            absent = F.lit(None) if field.name in null_when_absent else F.lit("")
            return absent.cast(field.dataType).alias(field.name)
        value = F.col(f"`{field.name}`")
        return (strict_double(value) if isinstance(field.dataType, T.DoubleType) else value).alias(field.name)

    return raw.select(*[column(f) for f in schema.fields])


def read_places(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_typed(spark, path, PLACES, PLACES_NULL_WHEN_ABSENT, **options)


def read_menu(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_typed(spark, path, MENU, MENU_NULL_WHEN_ABSENT, **options)


def read_overrides(spark: SparkSession, path: str, **options) -> DataFrame:
    """Override rows with all texts trimmed."""
    rows = read_typed(spark, path, OVERRIDES, **options)
    return rows.select(*[F.coalesce(trim_space(F.col(c)), F.lit("")).alias(c) for c in rows.columns])


def read_text_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame | None:
    """All columns of the file as text, blanks kept as empty text; None for a missing file."""
    raw = _read(spark, path, multi_line)
    return None if raw is None else raw.na.fill("")


def _cell(frame: DataFrame, name: str, zero_is_blank: bool) -> Column:
    value = F.col(name)
    if zero_is_blank and dict(frame.dtypes)[name] != "string":
        value = F.when(value != 0, value)
    return F.coalesce(value.cast("string"), F.lit("")).alias(name)


def write_table(
    frame: DataFrame, path: str, columns: list[str] | None = None, zero_is_blank: bool = False, mode: str = "overwrite"
) -> int:
    """Write a CSV table and return its number of rows; 0, and nothing touched, when there are none.

    The plan runs once, into the shared folder, which counts the rows; the CSV files
    are made from that. An unknown column is an error. ``zero_is_blank`` writes 0 as
    an empty cell, which loses the price of free things; by default it is kept.
    Line breaks in cells are quoted and need ``multi_line`` to be read.
    """
    chosen, seen = frame.select(*(columns or frame.columns)), Observation()
    cells = chosen.select(*[_cell(chosen, c, zero_is_blank) for c in chosen.columns])
    ready = stored(cells.observe(seen, F.count(F.lit(1)).alias("n")), "csv-rows")
    if seen.get["n"]:
        ready.write.mode(mode).csv(path, header=True, emptyValue="", quote='"', escape='"')
    return seen.get["n"]


def menu_export(places: DataFrame) -> DataFrame:
    """Menu rows of the places that have a summary, blanks for NULL."""
    chosen = places.filter(F.coalesce(F.col("menu_summary") != "", F.lit(False)))
    return chosen.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MENU_EXPORT])
