"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_slices

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digits", "spaces", "sentence_marks", "symbols", "other_marks", "wide_bytes",
    "distinct_words", "top_word", "same_as_next", "distinct_lines", "words_per_line", "symbol_words", "upper_words",
)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_SENTENCE = b".,;:?'\"-()"
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~!"
_WIDE = bytes(range(128, 256))
FEATURES, BLOCKS, BINS = 192, 32, 1024


def statistics(data: bytes) -> list[float]:
    """STATISTICS of one text; zeros for an empty one."""
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    words = data.split()
    count = max(1, len(words))
    lines = data.split(b"\n")
    seen = Counter(words)
    distinct = list(seen.items())
    upper = share(_UPPER)
    marks = (share(_SENTENCE), share(_SYMBOL))
    known = upper + share(_DIGIT) + share(_SPACE) + sum(marks) + share(_WIDE)
    return [
        np.log1p(n), np.log1p(len(words)), n / count, sum(c for w, c in distinct if len(w) > 20) / count, upper, share(_DIGIT), share(_SPACE), *marks,
        max(0.0, 1 - known), share(_WIDE), len(seen) / count, max(seen.values(), default=0) / count, sum(map(bytes.__eq__, words, words[1:])) / count,
        len(set(lines)) / len(lines), np.log1p(count / len(lines)), sum(c for w, c in distinct if w[-1] in _SYMBOL) / count,
        sum(c for w, c in distinct if len(w) > 1 and w.isupper()) / count,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                x = [statistics(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, x array<double>")


def fold(doc_id: Column) -> Column:
    """0 to 4 from the id: 0 is held out, 1 calibrates, the others fit."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # calibration: rising raw scores and the probability at each
    probability: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos(w x + b): inner products of these approximate a Gaussian kernel."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack((np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones(len(z))))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a thousandth of the plain margin so that the order within a step remains."""
        m = self.margin(x)
        return 0.999 * np.interp(m, self.raw, self.probability) + 0.001 / (1 + np.exp(-4 * (m - 0.5)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y, one partial sum from each of BLOCKS partitions."""
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.features(_matrix(batch))
            total += z.T @ np.column_stack((z, batch.column("y").to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.select("x", "y", "doc_id").repartition(BLOCKS, "doc_id").select("x", "y").mapInArrow(run, "sums binary")
    total = np.zeros((size, size + 1))
    for r in parts.toLocalIterator():
        total += np.frombuffer(r["sums"]).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means of y (weights n) over rising x: the centre and the value of each pooled block."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    total = np.array(blocks)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def fit(statistics_: DataFrame, labels: DataFrame, ridge: float = 1.0, width: float = 4.0, seed: int = 20) -> Model:
    """Fit on labelled rows outside the held-out fold. `width` is the kernel's, in standard deviations.

    Labels other than 0 and 1 count as missing; repeated labels of an id count as their mean. Without labelled
    rows every score is one half.
    """
    dims = len(STATISTICS)
    moments = statistics_.select(*[F.col("x")[i].alias(f"x{i}") for i in range(dims)]).agg(
        *[F.avg(f"x{i}") for i in range(dims)], *[F.stddev_pop(f"x{i}") for i in range(dims)]
    ).first()
    mean = np.array([moments[i] or 0.0 for i in range(dims)])
    scale = np.array([max(moments[dims + i] or 0.0, 1e-6) for i in range(dims)])
    draw = np.random.default_rng(seed)
    model = Model(
        mean, scale, draw.normal(size=(dims, FEATURES)) / width, draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1),
        np.array([0.0]), np.array([0.5]),
    )
    marked = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("quality").alias("y"))
    known = saved(statistics_.join(marked.filter(fold(F.col("doc_id")) != 0), "doc_id"))
    left, right = _normal_equations(known.filter(fold(F.col("doc_id")) > 1), model)
    if not left[-1, -1]:
        return model
    penalty = np.eye(FEATURES + 1) * ridge
    penalty[-1, -1] = 1e-9
    model = Model(mean, scale, model.directions, model.phases, np.linalg.solve(left + penalty, right), model.raw, model.probability)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model.margin(_matrix(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(m, -1, 2)), batch.column("y")], names=["m", "y"])

    bins = (
        known.filter(fold(F.col("doc_id")) == 1).select("x", "y").mapInArrow(margins, "m double, y double")
        .groupBy(F.floor(F.col("m") * (BINS / 3)).alias("bin")).agg(F.avg("m").alias("m"), F.avg("y").alias("y"), F.count("*").alias("n"))
        .orderBy("bin").collect()  # BINS rows at most
    )
    if not bins:
        return Model(mean, scale, model.directions, model.phases, model.weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    raw, probability = pool_adjacent(*(np.array([r[c] for r in bins], float) for c in ("m", "y", "n")))
    return Model(mean, scale, model.directions, model.phases, model.weights, raw, np.clip(probability, 0, 1))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Every document with `held_out`, `score` (0 to 1, higher: label 1 likelier) and `predicted`.

    Scores depend on the text alone. A null text counts as empty and is scored like one. Repeated rows, null
    ids and unlabelled documents give one row each; other columns are not carried. The statistics are written
    once to shared storage and read for moments, fit, calibration and scores.
    """
    known = saved(with_statistics(docs))
    model = fit(known, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return known.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
