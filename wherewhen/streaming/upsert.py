"""Refresh rows that arrive as a stream, merged batch by batch.

The merge needs the whole directory, so each micro-batch runs the batch operator
and writes a new version of the table next to the old one. A version is written
before it is announced and is named after its batch, so a batch that is repeated
after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import survivorship_merge

# Columns that put the rows of a version in output order.
ORDER = ["section", "appended", "position"]


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Highest version that a finished batch announced."""
    try:
        done = spark.read.text(f"{root}/done")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return done.agg(F.max(F.col("value").cast("int"))).first()[0]


def write_version(rows: DataFrame, root: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/version={version}")
    announced = rows.sparkSession.createDataFrame([(str(version),)], "value string")
    announced.coalesce(1).write.mode("append").text(f"{root}/done")


def merge_batch(batch: DataFrame, batch_id: int, root: str, order: str = "ord", **options) -> None:
    """Merge one micro-batch into the version before it; version 0 is the start.

    A batch either follows the last announced version or repeats the one that
    made it. Anything else is another stream's batch, for example of a new
    checkpoint on an old table, and is refused before it writes.
    """
    spark = batch.sparkSession
    latest = latest_version(spark, root) or 0
    if latest not in (batch_id, batch_id + 1):
        raise ValueError(f"batch {batch_id} does not follow version {latest} of {root}; use the stream's own checkpoint")
    existing = read_version(spark, root, batch_id)
    merged = survivorship_merge(existing, batch, order, **options)
    columns = [c for c in existing.columns if c != order]
    # Appended rows follow the ones there were; a name-only row keeps its place.
    last = existing.agg(F.max(order)).first()[0]
    first_free = 0 if last is None else last + 1
    position = F.col("position") + F.when(F.col("appended") == 1, F.lit(first_free).cast("long")).otherwise(F.lit(0).cast("long"))
    write_version(merged.select(position.alias(order), *columns), root, batch_id + 1)


def stream_refresh(
    spark: SparkSession, source: str, schema: T.StructType, root: str, checkpoint: str, order: str = "ord", **options
) -> StreamingQuery:
    """Merge every Parquet file that appears in ``source``; version 0 has to exist."""
    arriving = spark.readStream.schema(schema).parquet(source)
    return (
        arriving.writeStream.foreachBatch(lambda batch, i: merge_batch(batch, i, root, order, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
