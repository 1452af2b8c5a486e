"""Feature rows for any number of categories: positions by join, sparse vectors, scaling that keeps them sparse.

The dense form (`operators.prep`) collects its categories and writes a zero for each of them into
every row. Here the categories stay a table, rows hold what is not zero, and no task or driver sees
more than one number per feature of a model, as any fit does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from ..session import cut_lineage


@dataclass(frozen=True)
class SparseEncoder:
    """Categories of the training rows: `table` is `(name, value, position)`, positions from 0 in order of the value."""

    table: DataFrame
    sizes: dict[str, int]
    numeric: tuple[str, ...]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(self.sizes.values())

    def names(self) -> DataFrame:
        """`(j, feature)`: names by their place in the vector, as a table, since there may be millions."""
        first, offsets = len(self.numeric), {}
        for name, size in self.sizes.items():
            offsets[name], first = first, first + size
        numbers = self.table.sparkSession.createDataFrame(list(enumerate(self.numeric)), "j bigint, feature string")
        start = F.create_map(*[F.lit(x) for item in offsets.items() for x in item])
        return numbers.unionByName(self.table.select(
            (start[F.col("name")] + F.col("position")).alias("j"), F.concat_ws("_", "name", "value").alias("feature")))

    def positions(self, df: DataFrame) -> DataFrame:
        """`df` with `<column>_position` per categorical column, NULL for NULL and for values the training rows did not have.

        One left join per column. A value that most rows have does not gather them: a small table is broadcast by its
        size, and a large one leaves hot keys to the skew handling of the adaptive plan.
        """
        for name in self.sizes:
            known = self.table.filter(F.col("name") == name).select(F.col("value").alias("_value"), F.col("position").alias(f"{name}_position"))
            df = df.join(known, F.col(name).cast("string") == F.col("_value"), "left").drop("_value")
        return df

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """`keep` columns plus `vector`: numeric columns, then the indicators, stored sparse where that is shorter.

        A category the training rows did not have is all zeros; a NULL number is NaN, so it is not taken for data.
        """
        placed = self.positions(df)
        used = [name for name, size in self.sizes.items() if size]
        codes = [F.coalesce(F.col(f"{n}_position"), F.lit(self.sizes[n])).cast("double").alias(f"_c_{n}") for n in used]
        numbers = [F.col(c).cast("double").alias(f"_n_{c}") for c in self.numeric]
        rows = placed.select(*keep, *numbers, *codes)
        if used:
            rows = self._one_hot(used).transform(rows)
        assembler = VectorAssembler(inputCols=[*(f"_n_{c}" for c in self.numeric), *(f"_v_{n}" for n in used)], outputCol="vector", handleInvalid="keep")
        return assembler.transform(rows).select(*keep, "vector")

    def _one_hot(self, used: Sequence[str]) -> OneHotEncoderModel:
        """The place behind the last category stands for unknown values; it is the one that is left out."""
        top = self.table.sparkSession.createDataFrame([tuple(float(self.sizes[n] - 1) for n in used)], [f"_c_{n}" for n in used])
        return OneHotEncoder(
            inputCols=[f"_c_{n}" for n in used], outputCols=[f"_v_{n}" for n in used], handleInvalid="keep", dropLast=True).fit(top)


def fit_sparse(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> SparseEncoder:
    """Number the categories of each column; only the count per column reaches the driver."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(categorical)]))
    found = train.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull()).distinct()
    numbered = cut_lineage(number_rows(found, [F.col("at"), F.col("value")], "_k"))
    counts = {r["name"]: (r["n"], r["first"]) for r in numbered.groupBy("name").agg(F.count("*").alias("n"), F.min("_k").alias("first")).collect()}
    first = F.create_map(*[F.lit(x) for name, (_, k) in counts.items() for x in (name, k)]) if counts else None
    table = numbered.select("name", "value", (F.col("_k") - (first[F.col("name")] if counts else F.lit(0))).alias("position"))
    return SparseEncoder(table, {c: counts.get(c, (0, 0))[0] for c in categorical}, tuple(numeric))


@dataclass(frozen=True)
class SparseScaler:
    """Mean and population deviation per feature; a constant feature divides by 1.

    Rows are divided only: taking the mean away would fill in every zero. A linear model with a free intercept fits the
    same weights either way, and `centred` gives the intercepts that belong to centred rows.
    """

    mean: np.ndarray
    std: np.ndarray

    def apply(self, df: DataFrame, column: str = "vector") -> DataFrame:
        product = ElementwiseProduct(scalingVec=Vectors.dense(1.0 / self.std), inputCol=column, outputCol="_scaled")
        return product.transform(df).drop(column).withColumnRenamed("_scaled", column)

    def unscaled(self, weights: np.ndarray) -> np.ndarray:
        """Weights for rows as they are, of weights for scaled rows."""
        return np.asarray(weights) / self.std

    def centred(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Intercepts for rows that are centred and scaled, of a model of rows that are scaled only."""
        return np.asarray(bias) + np.asarray(weights) @ (self.mean / self.std)


def fit_sparse_scaler(train: DataFrame, column: str = "vector") -> SparseScaler:
    if train.isEmpty():  # the summary itself fails on no rows
        raise ValueError("no rows to fit the scaler on")
    row = train.select(Summarizer.metrics("count", "mean", "variance").summary(F.col(column)).alias("s")).first()["s"]
    std = np.sqrt(row["variance"].toArray() * (row["count"] - 1) / row["count"])
    return SparseScaler(row["mean"].toArray(), np.where(std > 0, std, 1.0))
