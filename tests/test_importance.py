"""Importance of fitted models against scoring whole permuted rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wardflow.operators import explain as xp
from wardflow.operators import importance as im
from wardflow.operators import models as md
from wardflow.operators.flows import sample_rows

N, WIDTH, SAMPLE, REPEATS = 600, 6, 150, 3
NAMES = [f"f{j}" for j in range(WIDTH)]


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes with narrow margins: feature 0 and 1 matter, 2 a little, the others are noise; some values repeat."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(N, WIDTH)), 1)
    score = np.stack([x[:, 0], x[:, 1], 0.4 * x[:, 2] + 0.3 * rng.normal(size=N)], axis=1)
    data = [(int(i), int(score[i].argmax()), [float(v) for v in x[i]]) for i in range(N)]
    return spark.createDataFrame(data, "id bigint, class_id int, features array<double>").repartition(3).cache()


def brute(model, rows):
    """Score every permuted row in full."""
    picked = sample_rows(rows, "id", SAMPLE)
    score = lambda df: model.transform(df.withColumn("vector", array_to_vector("features"))).agg(
        F.avg((F.col("prediction") == F.col("class_id")).cast("double"))).first()[0]
    base, mixed = score(picked), xp.permuted_rows(picked, REPEATS)
    out = []
    for j in range(WIDTH):
        moved = F.array(*[F.col("donor" if i == j else "features")[i] for i in range(WIDTH)])
        out.append(base - score(mixed.withColumn("features", moved)))
    return out


@pytest.mark.parametrize("make", [
    lambda: md.random_forest(trees=25, depth=8), lambda: md.boosted_trees(rounds=12, depth=3), lambda: md.logistic_regression(N, max_iter=50),
], ids=["forest", "booster", "linear"])
def test_equals_scoring_whole_rows(rows, make):
    model = make().fit(md.as_vectors(rows))
    found = {r["j"]: r for r in im.model_importance(model, rows, NAMES, sample=SAMPLE, repeats=REPEATS).collect()}
    got = [found[j]["importance"] for j in range(WIDTH)]
    assert [found[j]["feature"] for j in range(WIDTH)] == NAMES
    assert got == pytest.approx(brute(model, rows), abs=1e-9)
    assert got[0] > 0.05 and got[1] > 0.05 and max(got[3:]) < got[0]


def test_missing_values_go_where_the_booster_sends_them(spark, rows):
    gaps = rows.withColumn("features", F.transform("features", lambda x, i: F.when((i == 0) & (F.col("id") % 4 == 0), F.lit(float("nan"))).otherwise(x)))
    model = md.boosted_trees(rounds=6, depth=3).fit(md.as_vectors(gaps))
    got = [r["importance"] for r in im.model_importance(model, gaps, NAMES, sample=SAMPLE, repeats=REPEATS).orderBy("j").collect()]
    assert got == pytest.approx(brute(model, gaps), abs=1e-9)


def test_a_feature_no_tree_uses_and_an_empty_table(spark, rows):
    flat = rows.withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    model = md.random_forest(trees=5, depth=4).fit(md.as_vectors(flat))
    of = lambda df: {r["feature"]: r["importance"] for r in im.model_importance(model, df, [*NAMES, "flat"], sample=50, repeats=2).collect()}
    assert of(flat)["flat"] == 0.0
    assert set(of(flat.limit(0)).values()) == {0.0}
    assert set(of(flat.limit(1)).values()) == {0.0}  # a row is its own donor


def test_too_large_a_sample_is_refused(rows, monkeypatch):
    monkeypatch.setattr(im, "CELLS", 10)
    model = md.random_forest(trees=2, depth=2).fit(md.as_vectors(rows))
    with pytest.raises(ValueError, match="smaller sample"):
        im.model_importance(model, rows, NAMES, sample=SAMPLE, repeats=REPEATS)


def test_repeated_ids_and_other_models_are_refused(rows):
    model = md.boosted_trees(rounds=1, depth=1).fit(md.as_vectors(rows))
    with pytest.raises(ValueError, match="ids repeat"):
        im.model_importance(model, rows.withColumn("id", F.lit(1)), NAMES, sample=SAMPLE, repeats=1)
    with pytest.raises(TypeError):
        im.model_importance(object(), rows, NAMES)
