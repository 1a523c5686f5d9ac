"""A filter of bounded size for wide rows: which of them can have a wanted key.

The keys set bits in a bitmap of fixed size, which is small enough to be
broadcast however many keys there are. Rows whose bit is not set are dropped in
the scan, before their wide columns are read for anything or moved. Some rows
pass by chance (about keys / bits of them; all, where the keys are far more than
the bits), so an exact join on the key still has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24  # 2 MB, as 512 rows
_CHUNK = 1 << 15  # what one aggregated bitmap holds


def _bit(key: Column) -> tuple[Column, Column]:
    number = F.pmod(F.xxhash64(key), F.lit(BITS))
    return F.floor(number / _CHUNK).cast("int"), (number % _CHUNK).cast("int")


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """``chunk, bits`` of the keys: 512 rows of 4 KB at most."""
    chunk, place = _bit(F.col(key))
    return keys.where(F.col(key).isNotNull()).select(chunk.alias("__chunk"), place.cast("long").alias("place")).groupBy("__chunk").agg(
        F.bitmap_construct_agg("place").alias("__bits")
    )


def likely_rows(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """The rows whose key may be among those of the bitmap; no other row with such a key is lost."""
    chunk, place = _bit(F.col(key))
    marked = rows.withColumns({"__bit_chunk": chunk, "__bit_place": place}).join(F.broadcast(bitmap), F.col("__bit_chunk") == F.col("__chunk"))
    byte = F.conv(F.hex(F.expr("substring(__bits, __bit_place div 8 + 1, 1)")), 16, 10).cast("int")
    return marked.where(F.getbit(byte, F.col("__bit_place") % 8) == 1).select(*rows.columns)
