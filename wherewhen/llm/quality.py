"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Every whole text becomes a fixed vector of statistics. Random Fourier features
of the standardised vector approximate a Gaussian kernel; each partition sums
its share of the normal equations, and the driver solves one small system. The
raw scores of labelled rows that the ridge did not see are then calibrated by
isotonic regression over a fixed number of score bins. Nothing that reaches the
driver grows with the rows: D x D sums and at most ``bins`` pairs of counts.

Defined results: a null text counts as empty, and empty texts are scored like
any other. Rows of ``labels`` with a null id or label teach nothing; repeated
label rows count as often as they stand there. Without any label to learn from
each score is 1.0, since nothing is known against a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, stored

BANDS = (  # of byte values: what a document's characters are; bytes in none of them are class 0
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-",
    b"#$%&*@^~|<>{}[]\\/_=+`!?", b" \t\r\x0b\x0c", b"\n",
)
ODD, SPACE = 5, 6
CLASS = np.zeros(256, np.uint8)
for _number, _band in enumerate(BANDS, 1):
    CLASS[list(_band)] = _number
WIDTH = len(BANDS) + 9


def statistics(text: bytes) -> list[float]:
    """The fixed vector of one whole text (UTF-8); language, source and id have no part in it."""
    size = len(text)
    kinds = CLASS[np.frombuffer(text, np.uint8)]
    shares = np.bincount(kinds, minlength=len(BANDS) + 1) / max(size, 1)
    words = text.split()
    n = max(len(words), 1)
    lines = [line for line in text.split(b"\n") if line]
    blank = np.concatenate([[True], kinds >= SPACE, [True]])
    ends = ~blank[1:-1] & blank[2:]
    counts = Counter(words)
    return [
        *np.sqrt(shares), np.log1p(len(words)), min(size / n, 40.0) / 10, len(counts) / n,
        max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / max(len(lines), 1),
        np.sqrt(np.count_nonzero(ends & (kinds == ODD)) / n), np.sqrt(np.count_nonzero(ends & blank[:-2]) / n),
    ]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float32())
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        rows = [statistics(t.as_py() or b"") for t in texts]
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(rows, kind)], names=[*batch.schema.names[:-1], "stats"])


def document_vectors(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, stats of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _vectors, f"doc_id {kind}, stats array<float>"
    )


@dataclass(frozen=True)
class QualityModel:
    """All that scoring needs; a few hundred numbers, sent with the tasks."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores at the middle of each calibrated block
    levels: np.ndarray  # and its calibrated value
    prior: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([wave, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(stats), self.prior)
        return np.clip(np.interp(self.raw(stats), self.steps, self.levels), 0, 1)


def isotonic(position: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block middles and their non-decreasing means."""
    blocks: list[list[float]] = []
    for x, y, w in zip(position, mean, weight, strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _matrix(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def fit_quality(
    vectors: DataFrame, labels: DataFrame, *, features: int = 256, ridge: float = 1e-3, bandwidth: float = 4.0,
    bins: int = 2000, seed: int = 7, folds: int = 4, held_out: int = 2, calibrate_on: int = 3,
) -> QualityModel:
    """Learn from ``labels`` (doc_id, quality) and the vectors of all documents.

    Of ``folds`` remainders of crc32(doc_id), ``held_out`` is never read,
    ``calibrate_on`` calibrates and the others fit the ridge. ``bandwidth`` is
    the Gaussian kernel's width in standard deviations.
    """
    part = fold(F.col("doc_id"), folds)
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = vectors.where(part != held_out).join(known, "doc_id").select(part.alias("part"), "stats", "label")
    rows = stored(rows, "quality-rows")
    fitting, checking = rows.where(F.col("part") != calibrate_on), rows.where(F.col("part") == calibrate_on)
    moments = fitting.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(WIDTH)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(WIDTH)],
    ).first()
    rng = np.random.default_rng(seed)
    empty = np.zeros(0)
    frequencies = rng.normal(size=(WIDTH, features)) / bandwidth
    phases = rng.uniform(0, 2 * np.pi, features)
    if not moments["n"]:
        return QualityModel(empty, empty, frequencies, phases, empty, empty, empty, prior=1.0)
    mean = np.array([moments[f"m{i}"] for i in range(WIDTH)])
    scale = np.array([max(moments[f"s{i}"], 0.02) for i in range(WIDTH)])
    open_model = QualityModel(mean, scale, frequencies, phases, empty, empty, empty)
    size = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = open_model.features(_matrix(batch.column("stats")))
            left += x.T @ x
            right += x.T @ batch.column("label").to_numpy()
        both = np.hstack([left, right[:, None]])
        yield pa.RecordBatch.from_pydict({"line": np.arange(size, dtype=np.int32), "sums": list(both)})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": frame["line"].iloc[:1], "sums": [np.sum(np.stack(frame["sums"]), axis=0)]})

    schema = "line int, sums array<double>"
    lines = fitting.select("stats", "label").mapInArrow(sums, schema).groupBy("line").applyInPandas(total, schema)
    system = np.array([r["sums"] for r in sorted(lines.collect(), key=lambda r: r["line"])])
    penalty = ridge * moments["n"] * np.eye(size)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(system[:, :-1] + penalty + 1e-9 * np.eye(size), system[:, -1])
    fitted = QualityModel(mean, scale, frequencies, phases, weights, empty, empty)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(fitted.raw(_matrix(batch.column("stats"))), -1, 2)
            place = np.round((raw + 1) * bins / 3).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": place, "label": batch.column("label").to_numpy()})

    def counted(source: DataFrame) -> list:
        return source.select("stats", "label").mapInArrow(binned, "bin int, label double").groupBy("bin").agg(
            F.avg("label").alias("mean"), F.count("*").alias("n")
        ).orderBy("bin").collect()

    # With no row set aside for calibration the fitted rows have to do.
    table = counted(checking) or counted(fitting)
    steps, levels = isotonic(
        np.array([r["bin"] * 3 / bins - 1 for r in table]), np.array([r["mean"] for r in table]),
        np.array([float(r["n"]) for r in table]),
    )
    return QualityModel(mean, scale, frequencies, phases, weights, steps, levels)


def score_vectors(vectors: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of stored vectors."""
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.scores(_matrix(batch.column("stats"))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], names=["doc_id", "score"])

    return vectors.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")


def quality_score(text: Column, model: QualityModel) -> Column:
    """The score of a text column under a fitted model."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        stats = np.array([statistics(t.encode() if t else b"") for t in texts]).reshape(-1, WIDTH)
        return pd.Series(model.scores(stats))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept."""
    vectors = stored(document_vectors(docs), "quality-vectors")
    model = fit_quality(vectors, labels)
    return docs.where(quality_score(F.col("text"), model) >= threshold)
