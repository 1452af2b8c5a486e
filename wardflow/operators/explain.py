"""Robustness under gradient-sign steps and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import DEFAULT_SEED, hash_hex
from ..functions.vectors import argmax, gradient_sign, linear_scores
from ..session import cut_lineage
from .flows import sample_rows
from .rules import fix_struct

# --- Fixed values ---------------------------------------------------------------------------------
EPS = 0.05
EPS_GRID = (0.01, 0.05, 0.10, 0.20, 0.30)
CONFIDENCE = 0.7
EVASION = 0.50
SAMPLE = 2000
REPEATS = 5


def attacked(
    probes: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], grid: Sequence[float] = EPS_GRID,
    clip: tuple[float, float] | None = (0.0, 1.0), above: float = CONFIDENCE, key: str = "id",
) -> DataFrame:
    """`(id, eps, clean, adversarial)` for probes the linear softmax model is sure about.

    Each probe moves by eps along the sign of the loss gradient, kept inside `clip`.
    """
    score = linear_scores(weights, bias)
    sure = probes.select(key, "features", score("features").alias("probs")).filter(F.array_max("probs") > above)
    stepped = sure.select(
        key, "features", argmax(F.col("probs")).alias("clean"), gradient_sign(weights, bias)("features").alias("sign")
    ).withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in grid])))

    def move(x: Column, s: Column) -> Column:
        moved = x + F.col("eps") * s
        return moved if clip is None else F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), moved))

    moved = stepped.withColumn("features", F.zip_with("features", "sign", move))
    return moved.select(key, "eps", "clean", argmax(score("features")).alias("adversarial"))


def flip_rates(attacks: DataFrame) -> DataFrame:
    """Share of confident probes whose class flips, per eps."""
    flipped = F.col("clean") != F.col("adversarial")
    return attacks.groupBy("eps").agg(
        F.count("*").alias("probes"), F.count_if(flipped).alias("flips"), F.avg(flipped.cast("double")).alias("flip_rate")
    )


def evasion_findings(rates: DataFrame, model_file: str, threshold: float = EVASION, source: str = "real-samples") -> DataFrame:
    """A finding per eps whose flip rate is above the threshold."""
    pct = F.format_string("%.0f%%", F.col("flip_rate") * 100)
    shown = F.format_string("%.2f", "eps")
    return rates.filter(F.col("flip_rate") > threshold).select(
        F.lit("adversarial.fgsm-trivial-evasion").alias("rule_id"), F.lit("adversarial").alias("check"),
        F.lit("high").alias("severity"), F.lit("adversarial-robustness").alias("category"), F.lit(model_file).alias("file"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
        F.concat(F.lit("a gradient-sign step of eps="), shown, F.lit(" flips "), pct, F.lit(" of the confident probes ("),
                 F.col("flips").cast("string"), F.lit("/"), F.col("probes").cast("string"), F.lit(")")).alias("message"),
        F.concat(F.lit("attack_success="), pct, F.lit(", eps="), shown, F.lit(", n_probes="), F.col("probes").cast("string"),
                 F.lit(", n_flipped="), F.col("flips").cast("string"), F.lit(f", probes={source}")).alias("evidence"),
        fix_struct(F.lit("Train on perturbed inputs and measure the flip rate again."), F.lit("high")).alias("fix"),
    )


def permuted_rows(rows: DataFrame, repeats: int = REPEATS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Every sampled row per repeat with a donor row: a permutation of the sample by hash.

    The windows see the sample only (2,000 rows unless asked otherwise), once per repeat.
    """
    runs = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by_id = F.row_number().over(Window.partitionBy("repeat").orderBy("id"))
    by_hash = F.row_number().over(Window.partitionBy("repeat").orderBy(hash_hex(seed, F.col("repeat"), F.col("id")), "id"))
    donors = runs.select("repeat", by_hash.alias("place"), F.col("features").alias("donor"))
    return runs.withColumn("place", by_id).join(donors, ["repeat", "place"]).drop("place")


def permutation_importance(
    rows: DataFrame, predict_class: Callable[[Column], Column], names: Sequence[str], sample: int = SAMPLE,
    repeats: int = REPEATS, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """`(feature, importance)`: mean loss of accuracy when one feature is taken from a donor row.

    `rows` is `(id, class_id, features)`; `predict_class` maps a features column to a class column.
    """
    picked = cut_lineage(sample_rows(rows, "id", sample, seed))  # read three times below
    base = picked.agg(F.avg((predict_class(F.col("features")) == F.col("class_id")).cast("double")).alias("base"))
    mixed = permuted_rows(picked, repeats, seed).select(
        "repeat", "class_id", "features", F.posexplode("donor").alias("j", "value")
    ).withColumn("features", F.transform("features", lambda x, i: F.when(i == F.col("j"), F.col("value")).otherwise(x)))
    right = (predict_class(F.col("features")) == F.col("class_id")).cast("double")
    hits = mixed.select("repeat", "j", right.alias("right")).groupBy("repeat", "j").agg(F.avg("right").alias("right"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return hits.crossJoin(base).groupBy("j").agg(  # base is one row
        F.avg(F.col("base") - F.col("right")).alias("importance")
    ).select(named.alias("feature"), "j", "importance")


def top_features(importance: DataFrame, k: int = 5) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.asc("j")).limit(k)


def case_features(features: Column, top: Sequence[tuple[str, int, float]]) -> Column:
    """Map of the top features of a case to (value, importance), 4 decimals."""
    return F.map_from_entries(F.array(*[
        F.struct(F.lit(name), F.struct(
            F.round(F.element_at(features, j + 1), 4).alias("value"), F.lit(round(score, 4)).alias("importance")))
        for name, j, score in top
    ]))
