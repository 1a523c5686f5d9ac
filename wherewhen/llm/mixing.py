"""Mixing sources to target weights: repetition rates and hash-seeded copies.

Words are summed per source (partial sums before the shuffle, so a source with
a third of all rows is a few rows), target shares give each source a rate, and
every document is emitted floor(rate) times plus once more where a hash of its
id, read as a number between 0 and 1, falls below the fraction.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a document with a null id draws by its text. Repeated rows draw
alike. Sources without words have target 0 and rate 0. An empty table gives no
rows. Reruns and other partitionings agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, word_count

MAX_RATE = 3


def source_totals(docs: DataFrame, size: Column, source_col: str = "source") -> DataFrame:
    """source, source_size: one row per source."""
    return docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size")
    )


def cycled_weights(totals: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Sources in code-point order, null last, weigh the numbers of ``cycle`` in turn.

    One row per source is numbered in one task; rows of documents never are.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle)
    return totals.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), place + 1).cast("double"))


def capped_targets(weighted: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """Adds target: the total split by weight, no source above ``max_rate`` times its size.

    What capped sources leave is shared among the others by weight until none is
    above. Only the level, one number, passes through the driver; the rounds end
    when no further source is capped.
    """
    ceiling = F.col("source_size").cast("double") * max_rate
    level = 0.0
    while True:
        capped = ceiling < F.col("weight") * level
        row = weighted.agg(
            F.sum(F.col("source_size").cast("double")).alias("total"),
            F.sum(F.when(capped, ceiling).otherwise(0.0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        following = (row["total"] - row["held"]) / row["open"] if row["open"] else level
        if following <= level:
            break
        level = following
    return weighted.withColumn("target", F.least(ceiling, F.col("weight") * level))


def unit_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) drawn by the id (by the text where that is null): 52 bits of an MD5 sum."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixing_plan(docs: DataFrame, *, seed: str = "mix", max_rate: int = MAX_RATE, columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, rate and copies.

    ``columns`` names what else is carried (default: all). Names that the table
    already uses get underscores in front.
    """
    names = docs.columns if columns is None else columns
    size, total, target, rate, copies, key, draw, origin = (
        free_name(n, names) for n in ("size", "source_size", "target", "rate", "copies", "__source", "__draw", "__from")
    )
    totals = stored(source_totals(docs, word_count(F.col("text"))), "mix-totals")
    targets = stored(capped_targets(cycled_weights(totals), max_rate), "mix-targets")
    right = targets.select(F.col("source").alias(key), F.col("source_size").alias(total), F.col("target").alias(target))
    left = docs.select(
        *names, word_count(F.col("text")).alias(size), F.col("source").cast("string").alias(origin),
        unit_hash(F.col("doc_id"), F.col("text"), seed).alias(draw),
    )
    joined = left.join(right, left[origin].eqNullSafe(right[key]))
    per = F.when(F.col(total) > 0, F.least(F.col(target) / F.col(total), F.lit(float(max_rate)))).otherwise(0.0)
    whole = F.floor(F.col(rate))
    return (
        joined.withColumn(rate, per)
        .withColumn(copies, (whole + (F.col(draw) < F.col(rate) - whole).cast("long")).cast("long"))
        .select(*names, size, total, target, rate, copies)
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its plan says, same columns."""
    plan = mixing_plan(docs, **options)
    copies = plan.columns[-1]
    return (
        plan.where(F.col(copies) > 0)
        .withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
        .select(*docs.columns)
    )
