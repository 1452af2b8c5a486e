"""Sparse feature rows against the dense ones, unknown values, many categories, scaling folded into a linear model."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardflow.operators import models as md
from wardflow.operators import prep as pp
from wardflow.operators import sparse as sp

SCHEMA = "id bigint, class_id int, a double, proto string, b double, service string"


@pytest.fixture(scope="module")
def rows(spark):
    draw, out = random.Random(4), []
    for i in range(400):
        label = i % 3
        out.append((i, label, draw.gauss(label, 2), draw.choice("tui"), draw.gauss(0, 50), f"s{draw.randrange(6) + label}"))
    return spark.createDataFrame(out, SCHEMA)


def test_equal_to_the_dense_rows(spark, rows):
    test = rows.union(spark.createDataFrame([(900, 0, 1.0, "new", 2.0, None), (901, 1, 0.0, None, 0.0, "s1")], SCHEMA))
    dense = pp.fit_one_hot(rows, ("proto", "service"))
    want = {r["id"]: r["features"] for r in pp.feature_matrix(test, dense, ("id",), ("class_id",)).collect()}
    encoder = sp.fit_sparse(rows, ("proto", "service"), ("a", "b"))
    got = {r["id"]: r["v"] for r in encoder.apply(test, ("id",)).select("id", vector_to_array("vector").alias("v")).collect()}
    assert got == want and encoder.width == len(want[0])
    assert [r["feature"] for r in encoder.names().orderBy("j").collect()] == pp.feature_names(rows, dense, ("id", "class_id"))


def test_scaling_folds_into_a_linear_model(rows):
    encoder = sp.fit_sparse(rows, ("proto", "service"), ("a", "b"))
    vectors = encoder.apply(rows, ("id", "class_id"))
    scaler = sp.fit_sparse_scaler(vectors)
    dense = pp.feature_matrix(rows, pp.fit_one_hot(rows, ("proto", "service")), ("id", "class_id"))
    plain = pp.fit_scaler(dense)
    assert np.allclose(scaler.mean, plain.mean) and np.allclose(scaler.std, plain.std)
    lr = md.logistic_regression(400).setTol(1e-10)
    sparse = lr.fit(scaler.apply(vectors).withColumn("class_id", F.col("class_id").cast("double")))
    full = lr.fit(md.as_vectors(plain.apply(dense)))
    w, b = sparse.coefficientMatrix.toArray(), sparse.interceptVector.toArray()
    assert np.allclose(w, full.coefficientMatrix.toArray(), atol=2e-3)
    centred = scaler.centred(w, b)
    theirs = full.interceptVector.toArray()
    assert np.allclose(centred - centred.mean(), theirs - theirs.mean(), atol=2e-3)
    raw = np.array([r["v"] for r in vectors.orderBy("id").select(vector_to_array("vector").alias("v")).collect()])
    chosen = (raw @ scaler.unscaled(w).T + b).argmax(1)
    predicted = [r["prediction"] for r in sparse.transform(scaler.apply(vectors)).orderBy("id").collect()]
    assert chosen.tolist() == [int(p) for p in predicted]


def test_null_numbers_empty_tables_and_no_categories(spark, rows):
    encoder = sp.fit_sparse(rows.filter("id < 0"), ("proto",), ("a",))
    one = spark.createDataFrame([(1, 0, None, "t", 1.0, "x")], SCHEMA)
    assert encoder.width == 1 and np.isnan(encoder.apply(one, ("id",)).first()["vector"][0])
    assert sp.fit_sparse(rows, ("proto",), ("a",)).apply(rows.filter("id < 0"), ("id",)).count() == 0
    with pytest.raises(ValueError):
        sp.fit_sparse_scaler(encoder.apply(rows.filter("id < 0"), ("id",)))


def test_a_million_categories(spark):
    """Far above what the dense form accepts; every row holds two numbers. A third of the rows has one value."""
    n = 1_000_000
    df = spark.range(n + n // 2).select("id", F.when(F.col("id") < n, F.format_string("c%07d", "id")).otherwise("c0000005").alias("c"), F.lit(2.5).alias("x"))
    encoder = sp.fit_sparse(df, ("c",), ("x",))
    assert encoder.width == n + 1
    rows = encoder.apply(df, ("id",)).filter("id IN (0, 5, 999999, 1200000)").orderBy("id").collect()
    assert [(r["id"], r["vector"].size, r["vector"].indices.tolist(), r["vector"].values.tolist()) for r in rows] == [
        (0, n + 1, [0, 1], [2.5, 1.0]), (5, n + 1, [0, 6], [2.5, 1.0]), (999_999, n + 1, [0, n], [2.5, 1.0]), (1_200_000, n + 1, [0, 6], [2.5, 1.0])]
