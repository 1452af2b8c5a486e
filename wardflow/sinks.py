"""Writers of results as JSON lines; tables themselves are written as Parquet where they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_json(scores: DataFrame) -> DataFrame:
    """One JSON object per score row, 4 decimals, 1 for seconds."""
    digits = {"accuracy": 4, "f1_macro": 4, "f1_weighted": 4, "train_secs": 1}
    fields = [F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in scores.columns]
    return scores.select(F.to_json(F.struct(*fields)).alias("value"))


def result_document(scores: DataFrame, split: str = "test") -> DataFrame:
    """One JSON document of all models: `results` by model and split, and the `best_model` by macro-F1 on `split`.

    One row per model and split goes into it, so it stays small however many rows were scored.
    """
    digits = {"accuracy": 4, "f1_macro": 4, "f1_weighted": 4, "train_secs": 1}
    fields = ["model", "split", *[F.round(c, d).alias(c) for c, d in digits.items() if c in scores.columns]]
    on_split = F.when(F.col("split") == split, F.struct(F.round("f1_macro", 4).alias("f1"), F.col("model")))
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    # The best score, and the first name among those that have it.
    best = F.array_min(F.transform(
        F.filter(F.col("scored"), lambda s: s["f1"] == F.array_max(F.transform("scored", lambda t: t["f1"]))), lambda s: s["model"]))
    return scores.agg(ordered.alias("results"), F.collect_list(on_split).alias("scored")).select(
        F.to_json(F.struct("results", best.alias("best_model"))).alias("value"))


def decision_json(decisions: DataFrame, key: str) -> DataFrame:
    """Each decision as a JSON object beside its key."""
    return decisions.select(key, F.to_json(F.struct(*[c for c in decisions.columns if c != key])).alias("line"))


def case_json(cases: DataFrame, key: str) -> DataFrame:
    """Each case (its feature map included) as a JSON object beside its key."""
    return cases.select(key, F.to_json(F.struct("*")).alias("line"))


def case_document(top: DataFrame, cases: DataFrame, matrix: DataFrame) -> DataFrame:
    """One JSON document of an explained run.

    `top` `(feature, importance)` holds the few top features, `cases` `(category, index, confidence, severity, features)` one
    case per category with `features` as a map, `matrix` the decision rows. All three are small by construction; the
    decision log is not and stays in rows, see `decision_json`.
    """
    gathered = lambda df, name, first, *rest: df.agg(F.array_sort(F.collect_list(F.struct(first, *rest))).alias(name))
    features = gathered(top.select((-F.col("importance")).alias("_order"), "feature", F.col("importance").alias("score")), "f", "_order", "feature", "score")
    named = F.transform("f", lambda x: F.struct(x["feature"], x["score"]))
    rows = cases.select("category", "index", "confidence", "severity", F.array_sort(F.transform(F.map_entries("features"), lambda e: F.struct(
        e["key"].alias("name"), e["value"]["value"].alias("value"), e["value"]["importance"].alias("importance")))).alias("features"))
    found = gathered(rows, "cases", "category", "index", "confidence", "severity", "features")
    steps = gathered(matrix.select("lo", "hi", "severity", "action"), "decision_matrix", "lo", "hi", "severity", "action")
    one = features.select(named.alias("top_features")).crossJoin(found).crossJoin(steps)  # one row each
    return one.select(F.to_json(F.struct("top_features", "cases", "decision_matrix")).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
