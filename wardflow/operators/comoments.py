"""Counts, sums and products of all pairs of columns in one pass: one matrix per block of rows, matrices added up.

Every pair counts the rows that have both sides, so each cell has its own count, means and variances. Values are taken
relative to a shift per column (a mean from a first aggregate, the value itself where a column is constant), which keeps
large offsets exact. A partition sends k * k rows of sums however many rows it read, and the sums are merged by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "odd")
CONSTANT = 1e-13  # a variance below this part of the mean square is rounding


Parts = tuple[np.ndarray, np.ndarray, np.ndarray]  # values (0 where there is none), which are there, which are not finite


def _parts(batch: pa.RecordBatch, names: Sequence[str], shift: dict[str, float]) -> Parts:
    """The named columns as matrices, values relative to their shift."""
    values, there, odd = (np.zeros((batch.num_rows, len(names))) for _ in range(3))
    for j, name in enumerate(names):
        column = batch.column(name)
        x = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)
        there[:, j] = pc.is_valid(column).to_numpy(zero_copy_only=False)
        odd[:, j] = ~np.isfinite(x)
        values[:, j] = np.where((there[:, j] > 0) & np.isfinite(x), x - shift[name], 0.0)
    return values, there, odd


def _sums(x: Parts, y: Parts) -> list[np.ndarray]:
    """Per pair of columns: rows with both, sums, squares and products over them, and rows that hold no finite pair."""
    (a, v, o), (b, w, p) = x, y
    return [v.T @ w, a.T @ w, v.T @ b, (a * a).T @ w, v.T @ (b * b), a.T @ b, o.T @ w + v.T @ p]


def comoments(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> DataFrame:
    """`(a, b, n, covariance, variance_a, variance_b, correlation)` for each column of `left` with each of `right`.

    Population moments over the rows that have both sides. The correlation is null where a side is constant (or no row
    has both) and not-a-number where a value is not finite. `right` is `left` unless given.
    """
    right = list(left if right is None else right)
    names = list(dict.fromkeys([*left, *right]))
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))  # noqa: E731  (not-a-number compares as largest)
    looks = wide.agg(*[F.struct(F.min(finite(c)), F.max(finite(c)), F.avg(finite(c))).alias(c) for c in names]).first()
    shift = {c: 0.0 if looks[c][0] is None else looks[c][0] if looks[c][0] == looks[c][1] else looks[c][2] for c in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            sums = _sums(_parts(batch, left, shift), _parts(batch, right, shift))
            total = sums if total is None else [t + s for t, s in zip(total, sums)]
        if total is not None:
            i, j = np.indices(total[0].shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), *[pa.array(t.ravel()) for t in total]], names=["i", "j", *SUMS])

    added = wide.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    name = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(at) + 1)
    part = lambda s, mean: F.col(s) / F.col("n") - mean
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    spread = lambda square, m: F.when(part(square, m * m) > F.lit(CONSTANT) * F.col(square) / F.col("n"), part(square, m * m)).otherwise(0.0)
    odd = lambda c: F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(c)
    moments = added.filter("n > 0").select(
        name(left, "i").alias("a"), name(right, "j").alias("b"), F.col("n").cast("bigint").alias("n"), odd(part("sxy", mx * my)).alias("covariance"),
        odd(spread("sxx", mx)).alias("variance_a"), odd(spread("syy", my)).alias("variance_b"),
    )
    both = F.sqrt("variance_a") * F.sqrt("variance_b")
    pairs = df.sparkSession.createDataFrame([(a, b) for a in left for b in right], "a string, b string")
    return pairs.join(moments, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).withColumn(
        "correlation", F.when(F.isnan(both) | (both > 0), F.col("covariance") / both))
