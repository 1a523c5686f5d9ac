"""Merging intervals per group, without ever holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str, slices: int | None = None) -> DataFrame:
    """Disjoint intervals that cover the same ground; touching ones are joined.

    Starts and ends are integers of any unit. Equal starts are combined, and the
    rows are cut into ``slices`` of about equal row count by group and start
    (as many as the session has shuffle partitions), however starts are spread:
    a group is in as many slices as it has rows for. Running maxima are taken
    within a slice; what a slice has to know of those before it is one row per
    group and slice, a prefix maximum over at most ``slices`` rows. The island an
    interval belongs to is named by its own start, the latest one not covered by
    what came before, which is a second prefix maximum.

    The slices are written to the shared folder once, so that a row keeps its slice.
    """
    spark = rows.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tight = (
        rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
        .groupBy(F.struct(*keys).alias("__group"), F.col(start).cast("long").alias("__s"))
        .agg(F.max(F.col(end).cast("long")).alias("__e"))
    )
    sliced = stored(tight.repartitionByRange(n, "__group", "__s").withColumn("__slice", F.spark_partition_id()), "interval-slices")
    s, e = F.col("__s"), F.col("__e")
    slice_of = ["__slice", "__group"]
    in_slice = Window.partitionBy(*slice_of).orderBy("__s")
    before = in_slice.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__group").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)

    def carried(frame: DataFrame, column: str, into: str) -> DataFrame:
        """Greatest value of a column over all earlier slices, one row per group and slice."""
        per_slice = frame.groupBy(*slice_of).agg(F.max(column).alias(into))
        return per_slice.withColumn(into, F.max(into).over(earlier))

    local = sliced.withColumn("__before", F.max("__e").over(before))
    flagged = local.join(carried(sliced, "__e", "__reach"), slice_of).withColumn(
        "__opens", s > F.coalesce(F.greatest("__before", "__reach"), s - 1)
    ).withColumn("__home", F.max(F.when(F.col("__opens"), s)).over(so_far))
    housed = flagged.join(carried(flagged, "__home", "__old_home"), slice_of)
    return (
        housed.groupBy("__group", F.coalesce("__home", "__old_home").alias(start))
        .agg(F.max(e).alias(end))
        .select("__group.*", start, end)
    )
