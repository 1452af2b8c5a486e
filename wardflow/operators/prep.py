"""Feature preparation without leakage: what is fitted sees the training rows only.

Fitting gives a few bounded parameters (categories, cut points, means) on the driver, as any model
does; applying them is a row-wise projection that neither joins nor shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import fit_quota, mark_quota
from ..functions.rng import DEFAULT_SEED, hash_hex
from ..session import collect_bounded, cut_lineage

MAX_CATEGORIES = 5_000


# --- one-hot ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class OneHot:
    """Sorted categories per column, as the training rows showed them."""

    categories: dict[str, list[str]]

    def names(self) -> list[str]:
        return [f"{column}_{value}" for column, values in self.categories.items() for value in values]

    def columns(self) -> list[Column]:
        """Indicator columns; a value the training rows did not have is all zeros."""
        return [
            F.coalesce((F.col(column) == value).cast("double"), F.lit(0.0)).alias(f"{column}_{value}")
            for column, values in self.categories.items() for value in values
        ]


def fit_one_hot(train: DataFrame, columns: Sequence[str]) -> OneHot:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns]))
    found = train.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull()).distinct()
    seen: dict[str, list[str]] = {c: [] for c in columns}
    for row in collect_bounded(found, MAX_CATEGORIES, "one-hot categories"):
        seen[row["name"]].append(row["value"])
    return OneHot({c: sorted(values) for c, values in seen.items()})


def feature_names(df: DataFrame, encoder: OneHot, exclude: Sequence[str]) -> list[str]:
    """Numeric columns in table order, then the indicators: the matrix's column order."""
    left_out = {*exclude, *encoder.categories}
    return [c for c in df.columns if c not in left_out] + encoder.names()


def feature_matrix(df: DataFrame, encoder: OneHot, keep: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """`keep` columns plus `features`, aligned to the training columns.

    A category the training rows did not have is all zeros. A NULL number is no zero: it stays NULL in the array, and
    `incomplete` finds such rows, so a short input line is not taken for data.
    """
    left_out = {*exclude, *keep, *encoder.categories}
    numeric = [F.col(c).cast("double") for c in df.columns if c not in left_out]
    return df.select(*keep, F.array(*numeric, *encoder.columns()).alias("features"))


def incomplete(df: DataFrame, column: str = "features") -> DataFrame:
    """Rows with a NULL among their features."""
    return df.filter(F.exists(column, lambda x: x.isNull()))


def align(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the given columns: missing ones 0, NULLs 0, extra ones gone."""
    present = set(df.columns)
    return df.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in present else F.lit(0).alias(c) for c in columns])


# --- stratified split ---------------------------------------------------------------------------

def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """`(g, n)`."""
    return df.groupBy(F.col(label).alias("g")).agg(F.count("*").alias("n"))


def largest_remainder(sizes: DataFrame, total: int) -> DataFrame:
    """`(g, quota)`: shares of `total` proportional to the sizes `(g, n)`, whole numbers that add up exactly.

    The rows that rounding down leaves over go to the largest remainders, equal ones in order of the class as
    text. Classes are ranked in one window over the table of classes.
    """
    every = Window.partitionBy()
    parts = sizes.withColumn("_all", F.sum("n").over(every)).withColumn("_product", F.col("n").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)"))
    rest = parts.withColumn("_rest", F.col("_product") % F.col("_all")).withColumn("quota", ((F.col("_product") - F.col("_rest")) / F.col("_all")).cast("bigint"))
    order = F.row_number().over(Window.orderBy(F.desc("_rest"), F.col("g").cast("string")))
    short = F.lit(total) - F.sum("quota").over(every)
    return rest.withColumn("_order", order).withColumn("_short", short).select("g", (F.col("quota") + (F.col("_order") <= F.col("_short")).cast("int")).alias("quota"))


@dataclass(frozen=True)
class StratifiedSplit:
    """Cut points of the training part per class."""

    label: str
    key: str
    seed: int
    quotas: DataFrame
    cuts: DataFrame

    def mark(self, df: DataFrame, out: str = "in_train") -> DataFrame:
        return mark_quota(df, self.label, self.key, hash_hex(self.seed, F.col(self.key)), self.cuts, out)

    def apply(self, df: DataFrame, train: str = "train", rest: str = "val") -> DataFrame:
        return self.mark(df, "_in_train").withColumn("split", F.when(F.col("_in_train"), train).otherwise(rest)).drop("_in_train")


def fit_stratified_split(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = DEFAULT_SEED
) -> StratifiedSplit:
    """Exact per-class proportions, for any number of classes; every row's side follows from its hash alone."""
    sizes = cut_lineage(class_sizes(df, label))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    quotas = cut_lineage(largest_remainder(sizes, total - ceil(Fraction(str(test_size)) * total)))
    return StratifiedSplit(label, key, seed, quotas, fit_quota(df, label, key, hash_hex(seed, F.col(key)), quotas))


# --- scaling ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature divides by 1."""

    mean: list[float]
    std: list[float]

    def apply(self, df: DataFrame, column: str = "features") -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(self.mean, self.std)])
        return df.withColumn(column, F.zip_with(column, pairs, lambda x, p: (x - p["m"]) / p["s"]))


def fit_scaler(train: DataFrame, column: str = "features") -> Scaler:
    """One pass with a single vector summary per task, whatever the number of features."""
    summary = train.select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(column)).alias("s"))
    row = summary.first()["s"]
    n = row["count"]
    if not n:
        raise ValueError("no rows to fit the scaler on")
    shrink = (n - 1) / n  # the summary's variance is the sample variance
    std = [(v * shrink) ** 0.5 for v in row["variance"].toArray().tolist()]
    return Scaler(row["mean"].toArray().tolist(), [s if s > 0 else 1.0 for s in std])


def scale_columns(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column-wise scaling of a wide table, fitted on `train`."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns(scaled)


def prepared_export(parts: dict[str, DataFrame], path: str) -> None:
    """Write prepared rows `(row_id, features, class_id)` of all splits, partitioned by split."""
    for split, rows in parts.items():
        rows.select("row_id", "features", "class_id", F.lit(split).alias("split")).write.mode("append").partitionBy(
            "split"
        ).parquet(path)


def attack_probes(prepared: DataFrame, normal_id: int) -> DataFrame:
    return prepared.filter(F.col("class_id") != normal_id)
