"""Permutation importance of fitted models: only what a permuted feature can change is scored again.

A tree's answer for a row can change only if the row's path meets a split on the permuted feature, so a tree is walked
again for those rows alone; a linear score changes by one product. The trees are dealt over tasks, the sampled rows
(bounded by `sample`) go to each of them, and a task returns one block of score changes per repeat and feature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.base import Model
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import DEFAULT_SEED
from ..session import collect_bounded, cut_lineage, ensure_checkpoint_dir
from .boosting import HistogramModel, matrix
from .explain import REPEATS, SAMPLE, permuted_rows
from .flows import sample_rows

CELLS = 64_000_000  # score changes (repeats x features x rows x classes) that one task may hold
PARTS = 32  # tasks that trees are dealt over
DECIMALS = 9  # scores are compared so far: sums of the same votes in another order tie as they should
NODES = "tree int, id int, feature int, threshold double, `left` int, `right` int, value array<double>"


@dataclass(frozen=True)
class Tree:
    """Nodes by position, the root first; a leaf has feature -1. Values up to the threshold go left, missing ones right."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # what a node adds to the score of each class

    def leaves(self, x: np.ndarray, rows: np.ndarray, j: int = -1, donor: np.ndarray | None = None, met: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each of `rows` of x, with `donor` in place of feature j. `met` is told which splits a row passes."""
        at = np.zeros(len(rows), np.int64)
        going = np.arange(len(rows))
        while True:
            going = going[self.feature[at[going]] >= 0]
            if not len(going):
                return at
            node = at[going]
            feature = self.feature[node]
            v = x[rows[going], feature]
            if donor is not None:
                v = np.where(feature == j, donor[going], v)
            if met is not None:
                met[rows[going], feature] = True
            at[going] = np.where(v <= self.threshold[node], self.left[node], self.right[node])


def trees_of(nodes: pd.DataFrame) -> Iterator[Tree]:
    """The trees in rows of the schema NODES."""
    for _, tree in nodes.sort_values(["tree", "id"]).groupby("tree"):
        ids = tree["id"].to_numpy()
        place = lambda c: np.searchsorted(ids, tree[c].to_numpy())  # noqa: B023, E731
        yield Tree(tree["feature"].to_numpy(), tree["threshold"].to_numpy(), place("left"), place("right"), np.stack(tree["value"].to_numpy()))


def score_changes(trees: Iterator[Tree], x: np.ndarray, donors: np.ndarray, classes: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Scores `(row, class)` of the trees together, and per feature they split on the changes `(repeat, row, class)`.

    `donors` holds, per repeat, the row that each row takes the feature's value from.
    """
    everyone, repeats = np.arange(len(x)), len(donors)
    scores = np.zeros((len(x), classes))
    changes: dict[int, np.ndarray] = {}
    for tree in trees:
        met = np.zeros(x.shape, bool)
        old = tree.leaves(x, everyone, met=met)
        scores += tree.value[old]
        for j in np.unique(tree.feature[tree.feature >= 0]):
            change = changes.setdefault(int(j), np.zeros((repeats, len(x), classes)))
            hit = np.flatnonzero(met[:, j])
            rows = np.tile(hit, repeats)
            new = tree.leaves(x, rows, j, x[donors[:, hit].ravel(), j])
            change[:, hit] += (tree.value[new] - tree.value[old[rows]]).reshape(repeats, len(hit), classes)
    return scores, changes


def guesses(scores: np.ndarray) -> np.ndarray:
    """The best class of each row, of equal ones the first."""
    return np.round(scores, DECIMALS).argmax(axis=-1)


# --- nodes of fitted models -----------------------------------------------------------------------

def forest_nodes(model: RandomForestClassificationModel, spark: SparkSession) -> DataFrame:
    """Nodes of a fitted forest, read from its saved form: a leaf gives the shares of the classes in it, as a forest votes."""
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid4().hex}"
    model.save(path)
    saved = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    if saved.filter("leftChild >= 0 AND split.numCategories >= 0").limit(1).count():
        raise ValueError("the forest splits on categories; encode them as numbers or 0/1 columns first")
    rows = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    leaf = F.col("leftChild") < 0
    return saved.select(
        "tree", "id", F.when(leaf, -1).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.when(leaf, 0.0).otherwise(F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1))).alias("threshold"),
        F.when(leaf, F.col("id")).otherwise(F.col("leftChild")).alias("left"),
        F.when(leaf, F.col("id")).otherwise(F.col("rightChild")).alias("right"),
        F.transform("impurityStats", lambda n: F.when(rows > 0, n / rows).otherwise(0.0)).alias("value"),
    )


def booster_nodes(model: HistogramModel, spark: SparkSession) -> DataFrame:
    """Nodes of a fitted booster, its cuts between codes as thresholds; a tree adds to the score of its class only."""
    classes, rows = len(model.prior), []
    for number, tree in enumerate(t for trees in model.rounds for t in trees):
        for node, feature in enumerate(tree.feature):
            value = [0.0] * classes
            value[number % classes] = float(tree.value[node])
            edges = model.edges[feature] if feature >= 0 else ()
            cut = float(edges[tree.cut[node]]) if tree.cut[node] < len(edges) else float("inf")
            left = tree.left[node] if feature >= 0 else node
            rows.append((number, node, feature, cut, left, left + (feature >= 0), value))
    return spark.createDataFrame(rows, NODES)


# --- importance -----------------------------------------------------------------------------------

def _sampled(rows: DataFrame, sample: int, repeats: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, classes and donors per repeat of the sampled rows, by id."""
    picked = cut_lineage(sample_rows(rows.select("id", F.col("class_id").cast("int").alias("class_id"), "features"), "id", sample, seed))
    found = sorted(collect_bounded(picked, sample, "sampled rows"), key=lambda r: r["id"])
    place = {r["id"]: i for i, r in enumerate(found)}
    if len(place) < len(found):
        raise ValueError("ids repeat among the sampled rows")
    donors = np.zeros((repeats, len(found)), np.int64)
    mixed = permuted_rows(picked.select("id", F.col("id").alias("features")), repeats, seed).select("repeat", "id", "donor")
    for r in collect_bounded(mixed, sample * repeats, "donors"):
        donors[r["repeat"], place[r["id"]]] = place[r["donor"]]
    width = max((len(r["features"]) for r in found), default=0)
    x = np.array([r["features"] for r in found], float).reshape(len(found), width)
    return x, np.array([r["class_id"] for r in found], np.int64), donors


def _listed(spark: SparkSession, hits: DataFrame, names: Sequence[str]) -> DataFrame:
    """`(feature, j, importance)` for all names; a feature that no part of the model looks at has importance 0."""
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    every = spark.range(len(names)).select(F.col("id").cast("int").alias("j"))
    return every.join(hits, "j", "left").select(named.alias("feature"), "j", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def tree_importance(
    rows: DataFrame, nodes: DataFrame, names: Sequence[str], prior: Sequence[float], sample: int = SAMPLE,
    repeats: int = REPEATS, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """`(feature, j, importance)`: mean loss of accuracy when one feature is taken from a donor row.

    `rows` is `(id, class_id, features)`, ids unique; `nodes` has the schema NODES; `prior` is the score of each class before any
    tree. The same as scoring whole permuted rows, but that scores equal to DECIMALS places tie, the first class winning.
    Nothing to sample gives importance 0 throughout.
    """
    spark, classes = rows.sparkSession, len(prior)
    x, y, donors = _sampled(rows, sample, repeats, seed)
    if not len(x):
        return _listed(spark, spark.createDataFrame([], "j int, importance double"), names)
    if donors.size * x.shape[1] * classes > CELLS:
        raise ValueError(f"{donors.size * x.shape[1] * classes} score changes are over {CELLS}; take a smaller sample or fewer repeats")

    def of_part(part: pd.DataFrame) -> pd.DataFrame:
        scores, changes = score_changes(trees_of(part), x, donors, classes)
        blocks = [(-1, 0, scores.tobytes())] + [(j, r, c[r].tobytes()) for j, c in changes.items() for r in range(repeats)]
        return pd.DataFrame(blocks, columns=["j", "repeat", "scores"])

    walked = cut_lineage(nodes.withColumn("part", F.col("tree") % PARTS).repartition(PARTS, "part").groupBy("part").applyInPandas(of_part, "j int, repeat int, scores binary"))
    block = lambda raw: np.frombuffer(raw, float).reshape(len(x), classes)
    base = np.array(prior, float) + sum(block(r["scores"]) for r in collect_bounded(walked.filter("j < 0"), PARTS, "base scores"))
    right = float((guesses(base) == y).mean())

    def of_feature(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        moved = base + sum(block(raw) for raw in parts["scores"])
        return pd.DataFrame({"j": [key[0]], "loss": [right - float((guesses(moved) == y).mean())]})

    lost = walked.filter("j >= 0").groupBy("j", "repeat").applyInPandas(of_feature, "j int, loss double")
    return _listed(spark, lost.groupBy("j").agg(F.avg("loss").alias("importance")), names)


def linear_importance(
    rows: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], names: Sequence[str], sample: int = SAMPLE,
    repeats: int = REPEATS, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """The same for linear scores: feature j moves the score of a class by its weight times the difference to the donor."""
    w, b = np.array(weights, float), np.array(bias, float)
    picked = cut_lineage(sample_rows(rows.select("id", F.col("class_id").cast("int").alias("class_id"), "features"), "id", sample, seed))

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(w.shape[1], np.int64)
        seen = 0
        for batch in batches:
            x, donor = (matrix(batch.column(c), w.shape[1]) for c in ("features", "donor"))
            y = batch.column("class_id").to_numpy(zero_copy_only=False)
            base = x @ w.T + b
            right = guesses(base) == y
            for j in range(w.shape[1]):
                moved = guesses(base + np.outer(donor[:, j] - x[:, j], w[:, j]))
                total[j] += right.sum() - (moved == y).sum()
            seen += batch.num_rows
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(len(total)), pa.int32()), "lost": total, "seen": pa.array([seen] * len(total), pa.int64())})

    counted = permuted_rows(picked, repeats, seed).select("class_id", "features", "donor").mapInArrow(lost, "j int, lost bigint, seen bigint")
    hits = counted.groupBy("j").agg((F.sum("lost") / F.nullif(F.sum("seen"), F.lit(0))).alias("importance"))
    return _listed(rows.sparkSession, hits, names)


def model_importance(model: Model | HistogramModel, rows: DataFrame, names: Sequence[str], **how) -> DataFrame:
    """Importance of the features of any model of `operators.models`; `how` is sample, repeats and seed."""
    spark = rows.sparkSession
    if isinstance(model, HistogramModel):
        return tree_importance(rows, booster_nodes(model, spark), names, model.prior.tolist(), **how)
    if isinstance(model, RandomForestClassificationModel):
        return tree_importance(rows, forest_nodes(model, spark), names, [0.0] * model.numClasses, **how)
    if isinstance(model, LogisticRegressionModel):
        return linear_importance(rows, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), names, **how)
    raise TypeError(f"no importance for {type(model).__name__}")
