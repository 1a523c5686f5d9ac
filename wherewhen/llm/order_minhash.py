"""Order MinHash: fingerprints that follow edit distance.

A text is the sequence of its k-mers of code points, each with the number of its
occurrence so far. For each of ``sketches`` permutations the ``tuple_size``
numbered k-mers of least value are put back into text order and hashed together:
two texts agree in an entry only if they share those k-mers in the same order.

Defined results: a null text counts as empty. Texts shorter than ``k`` are one
k-mer; the empty text has a fingerprint of its own, equal to itself. Texts with
fewer k-mers than ``tuple_size`` use those there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, partitions

_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x7FB5D329728EA185)
    x = (x ^ (x >> _U64(27))) * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


_PLACE = _U64(24)
_PLACES = _U64((1 << 24) - 1)


def _sorted(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names (lower 24 bits clear) in order, equal ones by place, and their places; one packed word each where places fit."""
    if not len(places) or places.max() <= _PLACES:
        packed = names | places
        packed.sort()
        return packed & ~_PLACES, packed & _PLACES
    order = np.lexsort((places, names))
    return names[order], places[order]


@dataclass(frozen=True)
class OrderSketch:
    """Parameters of a fingerprint; equal parameters give comparable fingerprints.

    ``k`` is a power of two. Permutation i of the 40-bit names of numbered k-mers
    is the exclusive or with a random number, so its least values stand close to
    that number in the sorted names and are found by binary search, whatever the
    length of the text.
    """

    k: int = 8
    tuple_size: int = 2
    sketches: int = 128
    seed: int = 11

    def permutations(self) -> np.ndarray:
        draw = np.random.default_rng(self.seed).integers(0, 1 << 40, self.sketches, dtype=_U64)
        return np.sort(draw) << _PLACE

    def numbered(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of (k-mer, occurrence), in the upper 40 bits, sorted; and the position of each."""
        if len(points) < self.k:
            points = np.concatenate([points, np.full(self.k - len(points), 0x110000, np.uint32)])
        codes, width, times = points.astype(_U64), 1, 0x9E3779B97F4A7C15
        while width < self.k:  # codes of twice the width from two neighbours
            codes = codes[:-width] * _U64(times) + codes[width:]
            width, times = 2 * width, times * times % (1 << 64)
        names, places = _sorted(_mix(codes) & ~_PLACES, np.arange(len(codes), dtype=_U64))
        again = np.flatnonzero(names[1:] == names[:-1]) + 1
        if not len(again):
            return names, places
        # A k-mer seen before is named anew by its text and the number of its occurrence.
        index = np.arange(len(names))
        first = np.ones(len(names), bool)
        first[again] = False
        occurrence = (index - np.maximum.accumulate(np.where(first, index, 0)))[again].astype(_U64)
        named = _mix((names[again] >> _PLACE) + occurrence * _U64(0xD6E8FEB86659FD93)) & ~_PLACES
        renamed, moved = _sorted(named, places[again])
        names, places = np.concatenate([names[first], renamed]), np.concatenate([places[first], moved])
        order = np.argsort(names, kind="stable")  # merges two sorted runs
        return names[order], places[order]

    def fingerprint(self, text: str, masks: np.ndarray, window: int = 32) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(self.sketches, np.uint16)
        table, places = self.numbered(points)
        # The names that share the longest run of leading bits with a mask are neighbours of it.
        span = min(window, len(table))
        start = np.clip(np.searchsorted(table, masks) - span // 2, 0, len(table) - span)
        near = table[start[:, None] + np.arange(span)] ^ masks[:, None]
        rows, least = np.arange(self.sketches), []
        for _ in range(min(self.tuple_size, span)):
            spot = near.argmin(axis=1)
            least.append(start + spot)
            near[rows, spot] = ~_U64(0)
        # Back into text order, then one hash of the tuple.
        chosen = np.stack(least, axis=1)
        chosen = np.take_along_axis(chosen, np.argsort(places[chosen], axis=1, kind="stable"), axis=1)
        names = table[chosen] >> _PLACE
        tuples = np.zeros(self.sketches, _U64)
        for t in range(names.shape[1]):
            tuples = _mix(tuples * _U64(0x9E3779B97F4A7C15) + names[:, t] + _U64(1))
        return (tuples >> _U64(48)).astype(np.uint16)


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    return float(np.mean(left == right))


def order_fingerprints(docs: DataFrame, sketch: OrderSketch | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``omh``: the fingerprint as hexadecimal text, four digits an entry."""
    sketch = sketch or OrderSketch()
    name = free_name("omh", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = sketch.permutations()
        for batch in batches:
            prints = [sketch.fingerprint(t.as_py() or "", draws).astype(">u2").tobytes().hex() for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, _with(docs, f"`{name}` string"))


def _with(docs: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), more])


def neighbour_slices(docs: DataFrame, slices: int) -> DataFrame:
    """doc_id, tie, text, slice, guest: rows cut by doc_id, each slice with the first row of the following one.

    Rows stand in order of doc_id (null ids last), then ``tie``, a hash of the text,
    then text. Slice borders are quantiles of the ids; rows without an id are cut by
    ``tie``, in as many slices as their share asks for. ``guest`` is 1 for the one
    row a slice borrows; the last slice borrows the very first row. The driver sees
    an id and a hash per slice.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    at = [i / slices for i in range(1, slices)]
    found = rows.agg(
        F.percentile_approx("doc_id", at or [0.5], 20 * slices).alias("borders"), F.count("*").alias("n"), F.count("doc_id").alias("named")
    ).first()
    borders = sorted({float(x) for x in found["borders"] or []}) if at else []
    cut = Bucketizer(
        splits=[-float("inf"), *borders, float("inf")] if borders else [-float("inf"), 0.0, float("inf")],
        inputCol="place", outputCol="slice", handleInvalid="keep",
    )
    placed = cut.transform(rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))).drop("place")
    nameless = max(1, -(-slices * (found["n"] - found["named"]) // max(found["n"], 1)))
    piece = F.floor((F.col("tie") / 2.0**64 + 0.5) * nameless)
    last = F.least(piece, F.lit(nameless - 1))
    placed = placed.withColumn("slice", (F.col("slice") + F.when(F.col("doc_id").isNull(), last).otherwise(0)).cast("int"))
    firsts = sorted(placed.groupBy("slice").agg(F.min(F.struct("doc_id", "tie")).alias("first")).collect(), key=lambda r: r["slice"])
    hosted = placed.withColumn("guest", F.lit(0))
    if not firsts:
        return hosted
    lends = [(*firsts[i]["first"], firsts[i - 1]["slice"]) for i in range(len(firsts))]
    borrowed = docs.sparkSession.createDataFrame(lends, "first long, first_tie long, host int")
    same = placed["doc_id"].eqNullSafe(borrowed["first"]) & (placed["tie"] == borrowed["first_tie"])
    lent = placed.join(F.broadcast(borrowed), same).groupBy("doc_id", "tie", "host").agg(F.min("text").alias("text"))  # one row a slice
    return hosted.unionByName(lent.select("doc_id", "tie", "text", F.col("host").alias("slice"), F.lit(1).alias("guest")))


def edited_fingerprints(docs: DataFrame, sketch: OrderSketch | None = None, slices: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document.

    The edited form replaces the last half (floor) of the code points by as many
    of the next document in ascending doc_id, or all of it; the first follows
    the last. Rows of one id stand in order of a hash of their text, then text; rows
    without an id come last. Texts are shuffled once, by slice of ids, a slice a
    task; each task streams its slice in order. Other columns are dropped; an empty
    table gives no rows.
    """
    sketch = sketch or OrderSketch()
    spark = docs.sparkSession
    count = slices or partitions(spark)
    placed = neighbour_slices(docs, count)
    ordered = placed.repartitionById(2 * count, "slice").sortWithinPartitions("slice", "guest", "doc_id", "tie", "text")

    def finish(row: tuple, after: tuple, draws: np.ndarray) -> tuple:
        doc_id, text, own = row
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        changed = sketch.fingerprint(edited, draws)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.astype(">u2").tobytes().hex(),
            changed.astype(">u2").tobytes().hex(), likeness(own, changed), likeness(own, after[2]),
        )

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = sketch.permutations()
        waiting, current = None, None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                doc_id, text, piece = (batch.column(c)[i].as_py() for c in ("doc_id", "text", "slice"))
                if piece != current:
                    waiting, current = None, piece
                row = (doc_id, text, sketch.fingerprint(text, draws))
                if waiting is not None:
                    done.append(finish(waiting, row, draws))
                waiting = row  # a slice ends with the row it borrows
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema=schema)

    return ordered.mapInArrow(run, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    ))
