"""Packing into optimal length buckets.

The histogram of all lengths is counted once; dynamic programming over it finds
the boundaries that minimise padding for a given number of buckets. Inside a
bucket, rows are numbered and cut into batches of as many rows as the token
budget holds at the bucket's boundary.

The histogram that reaches the driver has a row per distinct length: it is
bounded by the longest text, not by the number of rows. Numbering splits each
bucket into slices of a bounded number of rows, so a bucket with a third of all
rows is many tasks, and only a bucket's last batch can be short.

Defined results: null and empty texts have length 0 and share a bucket of
padded length 1. A row longer than the budget is a batch by itself, uncut. Ties
in order are settled by id, then by a hash of the text; repeated rows are rows
of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, word_count


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` padded lengths, out of the sorted ``lengths``, with the least padding.

    With j the last length of a bucket, best(j) = min over i < j of the best for
    fewer buckets up to i, plus length_j times the rows in between. For each
    number of buckets that is a minimum over lines with ascending queries, found
    on their lower hull, so the table takes lengths x buckets steps.
    """
    n = len(lengths)
    if not n:
        return []
    top = [int(x) for x in lengths]
    rows = [0, *(int(x) for x in np.cumsum(counts))]
    single = [top[j] * rows[j + 1] for j in range(n)]
    best, origins = single, [[-1] * n]
    for _ in range(1, min(buckets, n)):
        now, origin = list(single), [-1] * n
        hull: list[tuple[int, int, int]] = []  # slope, intercept, index; slopes fall
        head = 0
        for j in range(1, n):
            slope, base = -rows[j], best[j - 1]
            while len(hull) - head >= 2:
                (s1, b1, _), (s2, b2, _) = hull[-2], hull[-1]
                if (base - b1) * (s1 - s2) > (b2 - b1) * (s1 - slope):
                    break
                hull.pop()
            hull.append((slope, base, j - 1))
            x = top[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            value = hull[head][0] * x + hull[head][1] + x * rows[j + 1]
            if value < now[j]:
                now[j], origin[j] = value, hull[head][2]
        best = now
        origins.append(origin)
    out, j = [], n - 1
    for origin in reversed(origins):
        out.append(top[j])
        j = origin[j]
        if j < 0:
            break
    return sorted(set(out))


def length_histogram(docs: DataFrame, length: Column) -> DataFrame:
    return docs.groupBy(length.cast("long").alias("length")).agg(F.count("*").alias("rows")).orderBy("length")


def packed_buckets(
    docs: DataFrame, *, buckets: int = 16, token_budget: int = 65536, length: Column | None = None,
    columns: list[str] | None = None, slice_rows: int = 10_000, boundaries: list[int] | None = None,
) -> DataFrame:
    """Rows of ``docs`` with length, bucket, padded_length and batch.

    ``length`` is the number of tokens, words by default. ``columns`` says what
    is carried along (default: all). Batches are numbered within their bucket.
    """
    names = docs.columns if columns is None else columns
    size, bucket, padded, batch, piece, place, before, draw, right_bucket, right_piece = (
        free_name(n, names) for n in (
            "length", "bucket", "padded_length", "batch", "__slice", "__place", "__before", "__draw", "__bucket", "__piece",
        )
    )
    length = word_count(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    # Stored, so that a text is read for its length once, not again by each use of it.
    rows = stored(docs.select(*names, length.alias(size), F.xxhash64("doc_id", "text").alias(draw)), "bucket-lengths")
    table = length_histogram(rows, F.col(size)).collect()
    padded_sizes = np.maximum(np.array([r["length"] for r in table], np.int64), 1)
    counts = np.array([r["rows"] for r in table], np.int64)
    if boundaries is None:
        boundaries = optimal_boundaries(padded_sizes, counts, buckets)
    boundaries = boundaries or [1]
    in_bucket = np.bincount(np.searchsorted(boundaries, padded_sizes), counts, len(boundaries))
    edges = F.array(*[F.lit(int(b)).cast("long") for b in boundaries])
    slices = F.array(*[F.lit(max(1, int(-(-rows // slice_rows)))) for rows in in_bucket])
    beyond = [(F.col(size) > int(edge)).cast("int") for edge in boundaries[:-1]]
    rows = rows.withColumn(bucket, sum(beyond, F.lit(0)))
    rows = rows.withColumn(padded, F.element_at(edges, F.col(bucket) + 1))
    rows = rows.withColumn(piece, F.pmod(F.col(draw), F.element_at(slices, F.col(bucket) + 1)))
    # The sizes of a bucket's slices give each slice its first number.
    sizes = stored(rows.groupBy(F.col(bucket).alias(right_bucket), F.col(piece).alias(right_piece)).count(), "bucket-slices")
    running = Window.partitionBy(right_bucket).orderBy(right_piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(right_bucket, right_piece, F.coalesce(F.sum("count").over(running), F.lit(0)).alias(before))
    order = Window.partitionBy(bucket, piece).orderBy("doc_id", draw)
    placed = rows.withColumn(place, F.row_number().over(order) - 1)
    placed = placed.join(starts, (F.col(bucket) == F.col(right_bucket)) & (F.col(piece) == F.col(right_piece)))
    held = F.greatest(F.floor(F.lit(token_budget) / F.col(padded)), F.lit(1))
    return placed.withColumn(batch, F.floor((F.col(before) + F.col(place)) / held).cast("long")).select(
        *names, size, bucket, padded, batch
    )
