"""Scoring of finding ids against golden expectations, as multisets per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_counts(ids: DataFrame) -> DataFrame:
    """`(file, rule_id, n)`: a multiset per file without collecting it."""
    return ids.groupBy("file", "rule_id").agg(F.count("*").alias("n"))


def multiset_score(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """TP / FP / FN per (file, rule) of two tables of `(file, rule_id)` rows, repeats counted."""
    want = id_counts(expected).withColumnRenamed("n", "want")
    got = id_counts(actual).withColumnRenamed("n", "got")
    want_n, got_n = F.coalesce("want", F.lit(0)), F.coalesce("got", F.lit(0))
    return want.join(got, ["file", "rule_id"], "full").select(
        "file", "rule_id", F.least(want_n, got_n).alias("tp"),
        F.greatest(got_n - want_n, F.lit(0)).alias("fp"), F.greatest(want_n - got_n, F.lit(0)).alias("fn"),
    )


def ratio_or_one(part: Column, whole: Column) -> Column:
    """0/0 counts as perfect."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(1.0))


def score_columns() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio_or_one(tp, tp + fp), ratio_or_one(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def check_scores(fixtures: DataFrame, expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Score per check.

    `fixtures` `(file, check)`; `expected` and `findings` `(file, rule_id)` rows. A fixture without
    expectations counts all its findings as false positives; a check whose fixtures give and expect
    nothing still has a row. Ids are counted per file and rule before anything is joined.
    """
    per_file = multiset_score(expected, findings).groupBy("file").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    return (
        fixtures.join(per_file, "file", "left").groupBy("check")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
        .select("check", "tp", "fp", "fn", *score_columns())
    )


def overall_recall(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.coalesce(F.try_divide(F.sum("tp").cast("double"), F.sum("tp") + F.sum("fn")), F.lit(1.0)).alias("overall_recall")
    )


def below_floor(scores: DataFrame, floor: float = 1.0) -> DataFrame:
    """Checks that fail the recall gate."""
    return scores.filter(F.col("recall") < floor)


def missing_baseline(fixtures: DataFrame, baseline: DataFrame) -> DataFrame:
    return fixtures.join(baseline, "file", "left_anti")


def regenerate_baseline(fixtures: DataFrame, findings: DataFrame) -> DataFrame:
    """`(file, rule_id, n)`: the new expectations as counts; a file without findings has one row without a rule.

    A multiset stays counts here, however often a rule fired; `spelled` writes it out in rows.
    """
    return fixtures.select("file").join(id_counts(findings), "file", "left").select(
        "file", "rule_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def spelled(baseline: DataFrame) -> DataFrame:
    """`(file, rule_id)` once for each expected occurrence, in order of file and rule within a file's rows."""
    times = F.explode(F.sequence(F.lit(1), F.col("n")))
    return baseline.filter("n > 0").select("file", "rule_id", times.alias("copy")).drop("copy")
