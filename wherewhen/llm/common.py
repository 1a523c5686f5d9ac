"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. A scratch folder
    is made only for a local session that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wherewhen-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends here.

    Later steps read files, so a lost executor costs no recomputation, and row
    numbers or partition numbers that were drawn on the way keep their values.
    """
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """As many partitions as the session sets for a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1)).cast("int")


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores in front until no other column has that name."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def _first_of_each(rows: DataFrame, names: list[str], id_col: str, digest: str) -> DataFrame:
    """One row, with columns ``names``, for each pair of id and digest; a join on both, or on the id, is partitioned for it."""
    number = free_name("__number", rows.columns)
    rest = [F.col(f.name) for f in rows.schema.fields if f.name in names and f.dataType.typeName() not in ("map", "variant")]
    window = Window.partitionBy(id_col, digest).orderBy(*rest)
    return rows.withColumn(number, F.row_number().over(window)).where(F.col(number) == 1).select(*names)


def once_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each pair of id and text; the others repeat it."""
    digest = free_name("__digest", docs.columns)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return _first_of_each(docs.withColumn(digest, F.sha2(text.cast("binary"), 256)), docs.columns, id_col, digest)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id, and SHA-256 of the text with A-Z lower-cased, stand in ``kept`` (id, digest).

    Ids are keys that no group of copies shares, so the join that moves texts has
    no hot key; rows without an id are dealt out by their texts. Texts move once. Of
    rows that repeat id and text one stays.
    """
    names = docs.columns
    key, digest, other = (free_name(n, names) for n in ("__key", "__sha", "__other"))
    right = kept.toDF(key, other).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = docs.withColumn(digest, F.sha2(lower_ascii(text).cast("binary"), 256))
    same = left[digest] == right[other]
    named = left.where(F.col(id_col).isNotNull()).join(right, (left[id_col] == right[key]) & same, "left_semi")
    nameless = left.where(F.col(id_col).isNull()).join(right.where(F.col(key).isNull()), same, "left_semi")
    return _first_of_each(named, names, id_col, digest).unionByName(_first_of_each(nameless, names, id_col, digest))
