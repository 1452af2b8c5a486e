"""Registered queries: feature preparation, oversampling, models, robustness, importance."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import CLASSES
from ..operators import explain as xp
from ..operators import flows as fl
from ..operators import forest as fo
from ..operators import importance as im
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import neighbours as kn
from ..operators import prep as pp
from ..operators import sparse as sr
from ..session import cut_lineage
from . import standins as st
from . import training as tr
from .registry import query
from .standins import NUMERIC_FLOW, sql

_CAT = ("protocol_type", "service", "flag")


# --- M1-M4, M11: preparation ----------------------------------------------------------------------

@query("M1_one_hot", sql("flows", """
  WITH n AS (SELECT 8 + count(DISTINCT protocol_type) + count(DISTINCT service) + count(DISTINCT flag) AS w FROM flows WHERE split = 'train'),
  s AS (SELECT DISTINCT service FROM flows WHERE split = 'train')
  SELECT id, CAST(w AS INT) AS width, 'protocol_type_' || protocol_type || CASE WHEN service IN (SELECT service FROM s) THEN ',service_' || service ELSE '' END || ',flag_' || flag AS hot FROM flows, n"""))
def _m1(spark, sf):
    flows = st.flows(spark, sf).select("id", "split", *_CAT, *NUMERIC_FLOW)
    encoder = pp.fit_one_hot(flows.filter("split = 'train'"), _CAT)
    names = encoder.names()
    matrix = pp.feature_matrix(flows, encoder, ("id",), ("split",))
    tail = F.slice("features", F.size("features") - len(names) + 1, len(names))
    hot = F.array_compact(F.zip_with(tail, F.array(*[F.lit(n) for n in names]), lambda x, n: F.when(x == 1.0, n)))
    return matrix.select("id", F.size("features").alias("width"), F.array_join(hot, ",").alias("hot"))


@query("M1_sparse_rows", sql("flows", """
  WITH t AS (SELECT * FROM flows WHERE split = 'train'),
  p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS j FROM (SELECT DISTINCT protocol_type AS v FROM t)),
  s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS j FROM (SELECT DISTINCT service AS v FROM t)),
  f AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS j FROM (SELECT DISTINCT flag AS v FROM t))
  SELECT id, CAST(8 + (SELECT count(*) FROM p) + (SELECT count(*) FROM s) + (SELECT count(*) FROM f) AS INT) AS width,
    p.j AS protocol_type_position, s.j AS service_position, f.j AS flag_position
  FROM flows LEFT JOIN p ON protocol_type = p.v LEFT JOIN s ON service = s.v LEFT JOIN f ON flag = f.v"""))
def _m1_sparse(spark, sf):
    """Width of every sparse row and where its categories stand, from the vectors themselves."""
    flows = st.flows(spark, sf).select("id", "split", *_CAT, *NUMERIC_FLOW)
    encoder = sr.fit_sparse(flows.filter("split = 'train'"), _CAT, NUMERIC_FLOW)
    vector, places, first = vector_to_array("vector"), [], len(encoder.numeric)
    for name, size in encoder.sizes.items():
        at = F.array_position(F.slice("_dense", first + 1, size), F.lit(1.0)) - 1
        places.append(F.when(at >= 0, at).alias(f"{name}_position"))
        first += size
    return encoder.apply(flows, ("id",)).withColumn("_dense", vector).select("id", F.size("_dense").alias("width"), *places)


@query("M2_stratified_split", sql("cat", """
  WITH c AS (SELECT category, count(*) AS n, sum(count(*)) OVER () AS total FROM cat GROUP BY 1),
  t AS (SELECT *, total - CAST(ceil(total * 2 / 10::DOUBLE) AS BIGINT) AS want FROM c),
  q AS (SELECT *, n * want // total AS base, row_number() OVER (ORDER BY n * want % total DESC, category) AS r, want - sum(n * want // total) OVER () AS short FROM t)
  SELECT id, category, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY md5('42|' || id), id) <= base + CASE WHEN r <= short THEN 1 ELSE 0 END THEN 'train' ELSE 'val' END AS split
  FROM cat JOIN q USING (category)"""))
def _m2(spark, sf):
    cat = fl.categorise(st.flows(spark, sf)).select("id", "category")
    return pp.fit_stratified_split(cat, "id", "category").apply(cat)


_UNNEST = "u AS (SELECT id, class_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM pts)"


@query("M3_standard_scaler", sql("pts", f"""
  WITH {_UNNEST}, m AS (SELECT i, avg(v) AS mu, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sd FROM u WHERE id % 5 <> 0 GROUP BY 1)
  SELECT id, round(max(CASE WHEN i = 1 THEN (v - mu) / sd END), 6) AS first, round(max(CASE WHEN i = 64 THEN (v - mu) / sd END), 6) AS last, round(sum((v - mu) / sd), 4) AS total
  FROM u JOIN m USING (i) GROUP BY 1"""))
def _m3(spark, sf):
    points = st.points(spark, sf)
    scaled = pp.fit_scaler(points.filter("id % 5 <> 0")).apply(points)
    return scaled.select("id", F.round(F.element_at("features", 1), 6).alias("first"), F.round(F.element_at("features", 64), 6).alias("last"),
                         F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("M3_scale_columns", sql("flows", """
  WITH m AS (SELECT avg(src_bytes) AS a, stddev_pop(src_bytes) AS b, avg(land) AS c FROM flows WHERE split = 'train')
  SELECT id, round((src_bytes - a) / b, 6) AS src_bytes, round(land - c, 6) AS land FROM flows, m"""))
def _m3c(spark, sf):
    flows = st.flows(spark, sf).select("id", "split", "src_bytes", "land")
    scaled = pp.scale_columns(flows.filter("split = 'train'"), flows, ("src_bytes", "land"))
    return scaled.select("id", F.round("src_bytes", 6).alias("src_bytes"), F.round("land", 6).alias("land"))


@query("M4_near_constant", sql("flows", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_pop({c}), 6) AS variance, var_pop({c}) > 0.01 AS kept FROM flows" for c in NUMERIC_FLOW)))
def _m4(spark, sf):
    return fl.near_constant(st.flows(spark, sf), NUMERIC_FLOW).withColumn("variance", F.round("variance", 6))


@query("M11_sample_rows", "SELECT event_id AS id FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 2000")
def _m11(spark, sf):
    return fl.sample_rows(st.events(spark, sf).select("id"), "id", 2000)


# --- J14, M5, X5: neighbours and oversampling -----------------------------------------------------

_KNN = """
  kn AS (SELECT * FROM (SELECT a.id, b.id AS neighbour_id, list_distance(a.x, b.x) AS distance,
           CAST(row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS INT) AS place
         FROM pts a JOIN pts b ON a.class_id = b.class_id AND a.id <> b.id) WHERE place <= 3)
"""


@query("J14_class_neighbours", sql("pts", f"WITH {_KNN} SELECT id, neighbour_id, place, round(distance, 6) AS distance FROM kn"))
def _j14(spark, sf):
    return kn.nearest_neighbours(st.points(spark, sf), 3).withColumn("distance", F.round("distance", 6))


@query("J14_forest_recall", sql("pts", f"WITH {_KNN} SELECT class_id, count(*) AS places, true AS recalled FROM kn JOIN pts USING (id) GROUP BY 1"))
def _j14_forest(spark, sf):
    """Places filled by the forest in each class, and whether nine in ten hold as near a neighbour as the exact search's."""
    points = st.points(spark, sf)
    exact = kn.nearest_neighbours(points, 3).select("id", "place", F.col("distance").alias("nearest"))
    found = fo.forest_neighbours(points, 3, recall=0.95, leaf_rows=64).neighbours.join(points.select("id", "class_id"), "id")
    hit = (F.col("distance") <= F.col("nearest") * (1 + 1e-12)).cast("double")
    return found.join(exact, ["id", "place"]).groupBy("class_id").agg(F.count("*").alias("places"), (F.avg(hit) >= 0.9).alias("recalled"))


_SMOTE = f"""{_KNN},
  c AS (SELECT class_id, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM pts GROUP BY 1),
  b AS (SELECT p.*, need // n + CASE WHEN row_number() OVER (PARTITION BY p.class_id ORDER BY md5('42-extra|' || id), id) <= need % n THEN 1 ELSE 0 END AS copies FROM pts p JOIN c USING (class_id) WHERE need > 0),
  k AS (SELECT id, class_id, x, CAST(unnest(range(copies)) AS INT) AS copy FROM b),
  d AS (SELECT k.*, ('0x' || substr(md5('42-mate|' || id || '|' || copy), 1, 8))::BIGINT % 3 + 1 AS place, ('0x' || substr(md5('42-step|' || id || '|' || copy), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM k),
  y AS (SELECT d.id, d.class_id, copy, kn.neighbour_id, list_transform(list_zip(d.x, m.x), lambda z: z[1] + u * (z[2] - z[1])) AS x FROM d JOIN kn ON kn.id = d.id AND kn.place = d.place JOIN pts m ON m.id = kn.neighbour_id)
"""


@query("M5_oversample", sql("pts", f"""
  WITH {_SMOTE} SELECT id, class_id, copy, neighbour_id, round(x[1], 6) AS first, round(list_sum(x), 4) AS total FROM y"""))
def _m5(spark, sf):
    made = kn.oversample(st.points(spark, sf)).filter("is_synthetic")
    return made.select("id", "class_id", "copy", "neighbour_id", F.round(F.element_at("features", 1), 6).alias("first"),
                       F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("A6_resampling_balance", sql("pts", "SELECT class_id, count(*) AS before, max(count(*)) OVER () AS after FROM pts GROUP BY 1"))
def _a6r(spark, sf):
    points = st.points(spark, sf)
    return kn.class_balance(points, kn.oversample(points))


@query("X5_original_and_synthetic", sql("pts", f"WITH {_SMOTE} SELECT id, class_id, false AS is_synthetic FROM pts UNION ALL SELECT id, class_id, true FROM y"))
def _x5(spark, sf):
    return kn.oversample(st.points(spark, sf)).select("id", "class_id", "is_synthetic")


# --- K4, K5: prepared exports ---------------------------------------------------------------------

@query("K4_prepared_export", sql("pts", """
  SELECT CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split, class_id, count(*) AS rows FROM pts GROUP BY 1, 2"""))
def _k4(spark, sf):
    path = st.scratch(spark, "prepared")
    points = st.points(spark, sf).withColumnRenamed("id", "row_id")
    scaler = pp.fit_scaler(points.filter("row_id % 5 <> 0"))
    scaled = scaler.apply(points)
    pp.prepared_export({"train": scaled.filter("row_id % 5 <> 0"), "test": scaled.filter("row_id % 5 = 0")}, path)
    return spark.read.parquet(path).groupBy("split", "class_id").agg(F.count("*").alias("rows"))


@query("K5_probe_export", sql("pts", "SELECT id, class_id FROM pts WHERE id % 5 = 0 AND class_id <> 1"))
def _k5(spark, sf):
    path = st.scratch(spark, "probes")
    points = st.points(spark, sf)
    scaled = pp.fit_scaler(points.filter("id % 5 <> 0")).apply(points)
    pp.attack_probes(scaled.filter("id % 5 = 0"), CLASSES.index("Normal")).write.parquet(path)
    return spark.read.parquet(path).select("id", "class_id")


# --- M9, M10, M13, A23, T3, C22: a linear model from class means ------------------------------------

_HEAT = 60.0


def centroid_model(points) -> tuple[list[list[float]], list[float]]:
    """Weights and bias of the nearest-mean classifier: one row of means per class."""
    means = points.select("class_id", F.posexplode("features").alias("j", "v")).groupBy("class_id", "j").agg(F.avg("v").alias("m"))
    rows = pp.collect_bounded(means, 1_000_000, "class means")
    classes, width = sorted({r["class_id"] for r in rows}), max(r["j"] for r in rows) + 1
    table = {(r["class_id"], r["j"]): r["m"] for r in rows}
    mu = [[table[(c, j)] for j in range(width)] for c in classes]
    return [[_HEAT * m for m in row] for row in mu], [-_HEAT * sum(m * m for m in row) / 2 for row in mu]


_MODEL = f"""{_UNNEST},
  w AS (SELECT class_id AS c, list({_HEAT}::DOUBLE * m ORDER BY i) AS w, -{_HEAT}::DOUBLE * sum(m * m) / 2 AS b FROM (SELECT class_id, i, avg(v) AS m FROM u GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT id, c, list_dot_product(x, w) + b AS s FROM pts, w),
  best AS (SELECT id, max(s) AS top, arg_max(c, s) AS clean FROM s GROUP BY 1),
  p AS (SELECT s.id, c, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY s.id) AS p, clean FROM s JOIN best USING (id)),
  sure AS (SELECT id FROM p GROUP BY 1 HAVING max(p) > 0.7),
  g AS (SELECT p.id, clean, i, sign(sum((p - CASE WHEN c = clean THEN 1 ELSE 0 END) * w.w[i])) AS sgn
        FROM p JOIN sure USING (id) JOIN w USING (c), range(1, 65) r(i) GROUP BY 1, 2, 3),
  a AS (SELECT g.id, eps, clean, list(least(1, greatest(-1, v + eps * sgn)) ORDER BY g.i) AS x FROM g JOIN u ON u.id = g.id AND u.i = g.i,
        (VALUES (0.01::DOUBLE), (0.05), (0.10), (0.20), (0.30)) e(eps) GROUP BY 1, 2, 3),
  att AS (SELECT a.id, eps, max(clean) AS clean, arg_max(c, list_dot_product(x, w) + b) AS adversarial FROM a, w GROUP BY 1, 2)
"""


def _attacks(spark, sf):
    points = st.points(spark, sf)
    return xp.attacked(points, *centroid_model(points), clip=(-1.0, 1.0))


@query("M9_gradient_sign", sql("pts", f"WITH {_MODEL} SELECT id, eps, clean, adversarial FROM att"))
def _m9(spark, sf):
    return _attacks(spark, sf)


@query("A23_flip_rates", sql("pts", f"""
  WITH {_MODEL} SELECT eps, count(*) AS probes, count(*) FILTER (clean <> adversarial) AS flips, round(avg(CASE WHEN clean <> adversarial THEN 1 ELSE 0 END), 6) AS flip_rate FROM att GROUP BY 1"""))
def _a23(spark, sf):
    return xp.flip_rates(_attacks(spark, sf)).withColumn("flip_rate", F.round("flip_rate", 6))


_EVADED = f"""{_MODEL}, fr AS (SELECT eps, count(*) AS n, count(*) FILTER (clean <> adversarial) AS k FROM att GROUP BY 1)"""


@query("M13_evasion_findings", sql("pts", f"""
  WITH {_EVADED} SELECT 'adversarial.fgsm-trivial-evasion' AS rule_id, 'high' AS severity,
    'attack_success=' || printf('%.0f%%', k / n::DOUBLE * 100) || ', eps=' || printf('%.2f', eps) || ', n_probes=' || n || ', n_flipped=' || k || ', probes=real-samples' AS evidence FROM fr WHERE k / n::DOUBLE > 0.5"""))
def _m13(spark, sf):
    return xp.evasion_findings(xp.flip_rates(_attacks(spark, sf)), "model").select("rule_id", "severity", "evidence")


@query("R17_trivial_evasion", sql("pts", f"WITH {_EVADED} SELECT 'adversarial' AS \"check\", 'model' AS file, CAST(NULL AS INT) AS line_start, count(*) AS n FROM fr WHERE k / n::DOUBLE > 0.5 GROUP BY 1, 2"))
def _r17(spark, sf):
    found = xp.evasion_findings(xp.flip_rates(_attacks(spark, sf)), "model")
    return found.groupBy("check", "file", "line_start").agg(F.count("*").alias("n"))


_IMPORTANCE = f"""{_UNNEST},
  w AS (SELECT class_id AS c, list({_HEAT}::DOUBLE * m ORDER BY i) AS w, -{_HEAT}::DOUBLE * sum(m * m) / 2 AS b FROM (SELECT class_id, i, avg(v) AS m FROM u GROUP BY 1, 2) GROUP BY 1),
  pick AS (SELECT * FROM pts ORDER BY md5('42|' || id), id LIMIT 2000),
  s AS (SELECT id, class_id, x, c, w, list_dot_product(x, w) + b AS s FROM pick, w),
  base AS (SELECT avg(CASE WHEN guess = class_id THEN 1.0::DOUBLE ELSE 0 END) AS base FROM (SELECT id, class_id, arg_max(c, s) AS guess FROM s GROUP BY 1, 2)),
  o AS (SELECT r, id, x, row_number() OVER (PARTITION BY r ORDER BY id) AS own, row_number() OVER (PARTITION BY r ORDER BY md5('42|' || r || '|' || id), id) AS other FROM pick, range(5) t(r)),
  d AS (SELECT o.r, o.id, q.x AS donor FROM o JOIN o q ON q.r = o.r AND q.other = o.own),
  z AS (SELECT d.r, j, s.id, s.class_id, arg_max(c, s.s + (donor[j] - x[j]) * w[j]) AS guess FROM s JOIN d USING (id), range(1, 65) t(j) GROUP BY 1, 2, 3, 4),
  imp AS (SELECT j, avg(base - rt) AS importance FROM (SELECT r, j, avg(CASE WHEN guess = class_id THEN 1.0::DOUBLE ELSE 0 END) AS rt FROM z GROUP BY 1, 2), base GROUP BY 1)
"""


def _importance(spark, sf):
    points = st.points(spark, sf)
    weights, bias = centroid_model(points)
    found = im.linear_importance(points, weights, bias, [f"f{j}" for j in range(len(weights[0]))])
    return found.withColumn("importance", F.round("importance", 6))


@query("M10_permutation_importance", sql("pts", f"WITH {_IMPORTANCE} SELECT 'f' || (j - 1) AS feature, CAST(j - 1 AS INT) AS j, round(importance, 6) AS importance FROM imp"))
def _m10(spark, sf):
    return _importance(spark, sf)


@query("T3_top_features", sql("pts", f"WITH {_IMPORTANCE} SELECT 'f' || (j - 1) AS feature, CAST(j - 1 AS INT) AS j, round(importance, 6) AS importance FROM imp ORDER BY round(importance, 6) DESC, j LIMIT 5"))
def _t3(spark, sf):
    return xp.top_features(_importance(spark, sf))


@query("C22_case_features", sql("pts", "SELECT id, round(x[1], 4) AS f0, round(x[10], 4) AS f9, 0.1235::DOUBLE AS importance FROM pts"))
def _c22(spark, sf):
    features = xp.case_features(F.col("features"), [("f0", 0, 0.12345678), ("f9", 9, 0.05)])
    read = st.points(spark, sf).select("id", features.alias("m"))
    return read.select("id", F.col("m")["f0"]["value"].alias("f0"), F.col("m")["f9"]["value"].alias("f9"), F.col("m")["f0"]["importance"].alias("importance"))


# --- M6-M8, M12, K2, L2: models -------------------------------------------------------------------

# Every feature tells the class with a wide margin, so each model must find it on rows it was not fitted on, and SQL
# knows all predictions. A fifth of the rows is the test table; the rest is split by class, one part in five for
# validation. Settings are the library's defaults: 1,000 iterations, 200 trees of depth 30, 200 rounds.
def _clear(spark, sf):
    y = F.col("class_id") % 5
    shifted = F.transform("features", lambda x, j: x * 0.1 + (y + j) % 5 * 3.0)
    return st.points(spark, sf).select("id", y.cast("int").alias("class_id"), shifted.alias("features"))


_FOLDS = """
  y AS (SELECT id, CAST(class_id % 5 AS INT) AS y FROM pts),
  c AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM y WHERE id % 5 <> 0 GROUP BY 1),
  t AS (SELECT *, total - CAST(ceil(total * 2 / 10::DOUBLE) AS BIGINT) AS want FROM c),
  q AS (SELECT *, n * want // total AS base, row_number() OVER (ORDER BY n * want % total DESC, CAST(y AS VARCHAR)) AS r, want - sum(n * want // total) OVER () AS short FROM t),
  f AS (SELECT id, y.y, CASE WHEN row_number() OVER (PARTITION BY y.y ORDER BY md5('42|' || id), id) <= base + CASE WHEN r <= short THEN 1 ELSE 0 END THEN 'train' ELSE 'val' END AS split
        FROM y JOIN q USING (y) WHERE id % 5 <> 0 UNION ALL SELECT id, y, 'test' FROM y WHERE id % 5 = 0)
"""


def _fitted(spark, sf, estimators):
    points = _clear(spark, sf)
    labelled = points.filter("id % 5 <> 0")
    marked = pp.fit_stratified_split(labelled, "id", "class_id").mark(labelled)
    return md.train_and_predict(
        marked.filter("in_train").drop("in_train"), {"val": marked.filter("NOT in_train").drop("in_train"), "test": points.filter("id % 5 = 0")}, estimators)


def _predicted(name):
    return sql("pts", f"WITH {_FOLDS} SELECT '{name}' AS model, split, id, y, y AS p FROM f WHERE split <> 'train'")


_ESTIMATORS = {"LogReg": md.logistic_regression, "RF": lambda rows: md.random_forest(), "HistGBM": lambda rows: md.boosted_trees()}


def _one(spark, sf, name):
    return _fitted(spark, sf, {name: _ESTIMATORS[name]}).predictions


@query("M6_logistic_regression", _predicted("LogReg"))
def _m6(spark, sf):
    return _one(spark, sf, "LogReg")


@query("M7_random_forest", _predicted("RF"))
def _m7(spark, sf):
    return _one(spark, sf, "RF")


@query("M8_boosted_trees", _predicted("HistGBM"))
def _m8(spark, sf):
    return _one(spark, sf, "HistGBM")


def _linear(spark, sf):
    """Weights and bias of the fitted logistic regression, and all points."""
    points = _clear(spark, sf)
    model = md.logistic_regression(points.count()).fit(md.as_vectors(points))
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray(), points


@query("M9_fitted_model", sql("pts", """
  SELECT id, unnest([0.01, 0.05, 0.1, 0.2, 0.3])::DOUBLE AS eps, CAST(class_id % 5 AS INT) AS clean, CAST(class_id % 5 AS INT) AS adversarial FROM pts"""))
def _m9_fitted(spark, sf):
    weights, bias, points = _linear(spark, sf)
    return xp.attacked(points, weights, bias, clip=None)  # the margin is wider than any step, so nothing flips


# Two 0/1 features tell four classes, so a permuted feature breaks just the rows whose donor has another value.
@query("M10_fitted_model", sql("pts", """
  WITH pick AS (SELECT id, class_id % 2 AS a, class_id // 2 % 2 AS b FROM pts ORDER BY md5('42|' || id), id LIMIT 2000),
  o AS (SELECT r, id, a, b, row_number() OVER (PARTITION BY r ORDER BY id) AS own, row_number() OVER (PARTITION BY r ORDER BY md5('42|' || r || '|' || id), id) AS other FROM pick, range(5) t(r)),
  d AS (SELECT avg(CASE WHEN o.a <> q.a THEN 1.0::DOUBLE ELSE 0 END) AS f0, avg(CASE WHEN o.b <> q.b THEN 1.0::DOUBLE ELSE 0 END) AS f1 FROM o JOIN o q ON q.r = o.r AND q.other = o.own),
  i AS (SELECT 'f0' AS feature, CAST(0 AS INT) AS j, f0 AS v FROM d UNION ALL SELECT 'f1', 1, f1 FROM d)
  SELECT model, feature, j, round(v, 6) AS importance FROM i, unnest(['HistGBM', 'LogReg', 'RF']) m(model)"""))
def _m10_fitted(spark, sf):
    bits = [F.col("class_id") % 2, F.floor(F.col("class_id") / 2) % 2]
    points = st.points(spark, sf).select("id", (bits[0] + 2 * bits[1]).cast("int").alias("class_id"), F.array(*[b.cast("double") for b in bits]).alias("features"))
    points = cut_lineage(points)
    vectors, rows = md.as_vectors(points), points.count()
    found = [im.model_importance(make(rows).fit(vectors), points, ["f0", "f1"]).withColumn("model", F.lit(name)) for name, make in _ESTIMATORS.items()]
    return reduce(DataFrame.unionByName, found).withColumn("importance", F.round("importance", 6))


@query("M12_model_loop", "SELECT m AS model, 'test' AS split, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1_macro, 1.0::DOUBLE AS f1_weighted FROM unnest(['HistGBM', 'LogReg', 'RF']) t(m)")
def _m12(spark, sf):
    return mt.ranking(_fitted(spark, sf, _ESTIMATORS).scores()).drop("train_secs")


@query("K2_result_document", sql("preds", """
  WITH n AS (SELECT model, split, y, p, count(*) AS n FROM preds GROUP BY 1, 2, 3, 4),
  s AS (SELECT model, split, y AS c, 0 AS hit, n, 1 AS actual FROM n UNION ALL SELECT model, split, p, 0, n, 0 FROM n UNION ALL SELECT model, split, y, 1, n, 2 FROM n WHERE y = p),
  t AS (SELECT model, split, c, coalesce(sum(n) FILTER (actual = 2), 0) AS tp, coalesce(sum(n) FILTER (actual = 1), 0) AS support, coalesce(sum(n) FILTER (actual = 0), 0) AS predicted FROM s GROUP BY 1, 2, 3),
  r AS (SELECT model, split, round(sum(tp) / sum(support)::DOUBLE, 4) AS accuracy, round(avg(2 * tp / (predicted + support)::DOUBLE), 4) AS f1_macro,
               round(sum(2 * tp / (predicted + support)::DOUBLE * support) / sum(support)::DOUBLE, 4) AS f1_weighted FROM t GROUP BY 1, 2)
  SELECT '{"results":[' || string_agg('{"model":"' || model || '","split":"' || split || '","accuracy":' || accuracy || ',"f1_macro":' || f1_macro || ',"f1_weighted":' || f1_weighted || '}', ',' ORDER BY model, split)
    || '],"best_model":"' || (SELECT model FROM r WHERE split = 'test' ORDER BY f1_macro DESC, model LIMIT 1) || '"}' AS value FROM r"""))
def _k2_document(spark, sf):
    from ..sinks import result_document

    return result_document(mt.scores(mt.confusion_counts(st.predictions(spark, sf))))


def training_flows(spark, sf):
    """Flows as a training and a test table, key and raw columns only; every number tells the category."""
    flows = st.dealt(st.flows(spark, sf).select("id", "split", "label", "difficulty_level", *_CAT, *NUMERIC_FLOW))
    known = fl.encode_category(fl.categorise(flows))
    shifted = {c: F.col(c) * 0.001 + (F.col("class_id") + j) % 5 * 3.0 for j, c in enumerate(NUMERIC_FLOW)}
    flows = known.withColumns(shifted).select(flows.columns)
    return flows.filter("split = 'train'").drop("split"), flows.filter("split = 'test'").drop("split")


_WHOLE = ", ".join(f"1.0::DOUBLE AS {m}_{s}" for m in ("accuracy", "f1_macro", "f1_weighted") for s in ("test", "val"))


@query("L2_training_run", f"SELECT m AS model, {_WHOLE} FROM unnest(['HistGBM', 'LogReg', 'RF']) t(m)")
def _l2(spark, sf):
    return mt.score_pivot(tr.run(*training_flows(spark, sf)).scores())
