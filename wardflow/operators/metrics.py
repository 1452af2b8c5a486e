"""Classification metrics from confusion counts.

Every metric starts from one map-side combined count per (model, split, actual, predicted); what
follows works on at most classes² rows per model and split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("model", "split")


def confusion_counts(predictions: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """`(…, y, p, n)` of rows with actual class `y` and predicted class `p`."""
    return predictions.groupBy(*by, "y", "p").agg(F.count("*").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def per_class(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs as actual or predicted."""
    sides = counts.select(*by, "n", F.explode(F.array(
        F.struct(F.col("y").alias("class_id"), F.lit(True).alias("actual"), (F.col("y") == F.col("p")).alias("hit")),
        F.struct(F.col("p").alias("class_id"), F.lit(False).alias("actual"), F.lit(False).alias("hit")),
    )).alias("s")).select(*by, "n", "s.*")
    totals = sides.groupBy(*by, "class_id").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("actual"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("actual"), F.col("n")).otherwise(0)).alias("predicted"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return totals.select(
        *by, "class_id", precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "tp",
    )


def _weighted(measure: str) -> Column:
    return _ratio(F.sum(F.col(measure) * F.col("support")), F.sum("support"))


def scores(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Accuracy, macro-F1 and weighted-F1."""
    return per_class(counts, by).groupBy(*by).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"),
        _weighted("f1").alias("f1_weighted"),
    )


def report(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per-class rows plus `macro avg` and `weighted avg` rows.

    A class counts for its own row and for both averages, so one grouping gives all three kinds.
    """
    measures = ("precision", "recall", "f1")
    rows = F.explode(F.array(F.col("class_id").cast("string"), F.lit("macro avg"), F.lit("weighted avg")))
    spread = per_class(counts, by).withColumn("row", rows)
    weight = F.when(F.col("row") == "weighted avg", F.col("support")).otherwise(F.lit(1))
    return spread.groupBy(*by, "row").agg(
        *[_ratio(F.sum(F.col(m) * weight), F.sum(weight)).alias(m) for m in measures], F.sum("support").alias("support")
    )


def confusion_matrix(counts: DataFrame, n_classes: int, by: Sequence[str] = BY) -> DataFrame:
    """Full grid in class order with row-normalised shares (an empty row divides by one).

    The counts of a model and split become one map of at most classes² entries, read per grid cell.
    """
    key = lambda: F.concat_ws(":", "y", "p")
    maps = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key(), "n"))).alias("_n"))
    ids = F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))
    grid = maps.withColumn("y", ids).withColumn("p", ids)
    full = grid.withColumn("n", F.coalesce(F.try_element_at("_n", key()), F.lit(0))).drop("_n")
    row_sum = F.sum("n").over(Window.partitionBy(*by, "y"))
    return full.withColumn("share", F.col("n") / F.greatest(row_sum, F.lit(1)))


def binary_counts(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """TP / TN / FP / FN of 0/1 columns `y` and `p`."""
    y, p = F.col("y") == 1, F.col("p") == 1
    return predictions.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
    )


def binary_scores(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, precision, recall and F1 in percent."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    percent = {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    return counts.select(*by, *[F.round(v * 100, 2).alias(n) for n, v in percent.items()])


def detected(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Records a model calls an attack, of how many."""
    return predictions.groupBy(*by).agg(F.sum("p").cast("bigint").alias("attacks"), F.count("*").alias("rows"))


def score_pivot(table: DataFrame, splits: Sequence[str] = ("test", "val")) -> DataFrame:
    """One row per model, each metric under each split, 4 decimals."""
    measures = ("accuracy", "f1_macro", "f1_weighted")
    wide = table.groupBy("model").pivot("split", list(splits)).agg(*[F.round(F.avg(m), 4).alias(m) for m in measures])
    return wide.select("model", *[F.col(f"{s}_{m}").alias(f"{m}_{s}") for m in measures for s in splits])


def split_gap(table: DataFrame, first: str = "val", second: str = "test") -> DataFrame:
    """How much each metric falls from one split to the other."""
    measures = ("accuracy", "f1_macro", "f1_weighted")
    of = lambda s, m: F.max(F.when(F.col("split") == s, F.col(m)))
    return table.groupBy("model").agg(*[F.round(of(first, m) - of(second, m), 4).alias(f"{m}_gap") for m in measures])


def ranking(table: DataFrame, split: str = "test") -> DataFrame:
    """Models by macro-F1 on a split, best first."""
    return table.filter(F.col("split") == split).orderBy(F.desc("f1_macro"), F.asc("model"))


def best_model(table: DataFrame, split: str = "test") -> DataFrame:
    return ranking(table, split).limit(1)


def comparison(binary: DataFrame, models: Sequence[str]) -> DataFrame:
    """Metrics as rows, models as columns."""
    measures = ("accuracy", "precision", "recall", "f1_score")
    long = binary.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in measures
    ])).alias("m")).select("model", "m.*")
    return long.groupBy("metric").pivot("model", list(models)).agg(F.max("v"))
