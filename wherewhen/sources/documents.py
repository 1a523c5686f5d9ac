"""Nested place documents and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_key
from ..operators.prune import key_bitmap, likely_rows
from ..schema import PLACE_DOCUMENT


def read_place_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; the schema is the field mask, other fields are never parsed."""
    return spark.read.schema(PLACE_DOCUMENT).json(path)


def page_by_url(pages: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """Requested addresses with the stored page, matched by key; NULL where none is stored.

    Of several pages the one with the greatest ``page_id`` counts (a page without
    one is last), then the greatest text. Pages that nobody asks for are dropped in
    the scan; the HTML of the others moves once, one page a key and task.
    """
    asked = urls.withColumn("page_key", url_key(F.col(url)))
    stored = pages.select("page_id", url_key(F.col("url")).alias("page_key"), "html")
    likely = likely_rows(stored, "page_key", key_bitmap(asked, "page_key"))
    found = likely.groupBy("page_key").agg(F.max(F.struct("page_id", "html"))["html"].alias("html"))
    return asked.join(found, "page_key", "left")
