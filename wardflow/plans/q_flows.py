"""Registered queries: flow records, exploration and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import CLASSES, DECISION_MATRIX, FLOW_COLUMNS, PROTECTED_HOSTS
from ..functions.vectors import argmax
from ..operators import decide as dc
from ..operators import flows as fl
from ..operators import metrics as mt
from ..operators.history import iso_utc
from ..sources.flows import read_flows
from . import standins as st
from .registry import query
from .standins import sql

_NUM = st.NUMERIC_FLOW
_WIDE = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


# --- S1, P1: reading ----------------------------------------------------------------------------

@query("S1_flow_csv", sql("flows", """
  SELECT id AS duration, protocol_type, service, flag, src_bytes, label, count, serror_rate, difficulty_level FROM flows"""))
def _s1(spark, sf):
    fl_rows = st.flows(spark, sf)
    given = {"duration": F.col("id").cast("int"), "protocol_type": "protocol_type", "service": "service", "flag": "flag",
             "src_bytes": "src_bytes", "count": "count", "serror_rate": "serror_rate", "label": "label", "difficulty_level": "difficulty_level"}
    columns = {name: F.col(c) if isinstance(c, str) else c for name, c in given.items()}
    line = F.concat_ws(",", *[columns.get(name, F.lit(0)).cast("string") for name in FLOW_COLUMNS])
    path = st.scratch(spark, "flows")
    fl_rows.select(line.alias("value")).write.text(path)
    return read_flows(spark, path).select(
        F.col("duration").cast("bigint").alias("duration"), "protocol_type", "service", "flag", "src_bytes", "label", "count", "serror_rate", "difficulty_level")


@query("P1_drop_proxy", sql("flows", "SELECT id, label, count FROM flows"))
def _p1(spark, sf):
    return fl.drop_label_proxy(st.flows(spark, sf).select("id", "label", "count", "difficulty_level"))


# --- P2-P6: categories --------------------------------------------------------------------------

@query("P2_categorise", sql("cat", "SELECT id, label, category FROM cat"))
def _p2(spark, sf):
    return fl.categorise(st.flows(spark, sf)).select("id", "label", "category")


@query("P3_categorise_known_only", sql("flows tax", "SELECT id, label, category FROM flows JOIN tax USING (label)"))
def _p3(spark, sf):
    return fl.categorise(st.flows(spark, sf), default=None).select("id", "label", "category")


@query("P4_unknown_labels", sql("flows tax", """
  WITH a AS (SELECT split, count(*) AS n FROM flows GROUP BY 1)
  SELECT split, label, count(*) AS rows, round(count(*) * 100.0::DOUBLE / max(n), 2) AS share_pct
  FROM flows JOIN a USING (split) WHERE label NOT IN (SELECT label FROM tax) GROUP BY 1, 2"""))
def _p4(spark, sf):
    return fl.unknown_labels(st.flows(spark, sf))


@query("P4_unknown_summary", sql("flows tax", """
  SELECT split, count(*) FILTER (label NOT IN (SELECT label FROM tax)) AS unknown_rows,
         round(count(*) FILTER (label NOT IN (SELECT label FROM tax)) * 100.0::DOUBLE / count(*), 2) AS share_pct FROM flows GROUP BY 1"""))
def _p4s(spark, sf):
    return fl.unknown_summary(st.flows(spark, sf))


@query("P5_encode_category", sql("cat", "SELECT id, category, class_id FROM cat"))
def _p5(spark, sf):
    return fl.encode_category(fl.categorise(st.flows(spark, sf)), fallback="Normal").select("id", "category", "class_id")


@query("P6_binary_label", sql("cat", "SELECT id, CASE WHEN category = 'Normal' THEN 0 ELSE 1 END AS is_attack FROM cat"))
def _p6(spark, sf):
    return fl.categorise(st.flows(spark, sf)).select("id", fl.binary_label(F.col("category")).alias("is_attack"))


@query("P7_threshold", sql("flows", "SELECT id, CAST(confidence > 0.5 AS INT) AS predicted FROM flows"))
def _p7(spark, sf):
    return st.flows(spark, sf).select("id", (F.col("confidence") > 0.5).cast("int").alias("predicted"))


@query("P8_argmax", sql("scored", "SELECT id, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS predicted FROM scored"))
def _p8(spark, sf):
    return st.scored(spark, sf).select("id", argmax(F.col("probs")).alias("predicted"))


@query("P11_attack_rows", sql("cat", "SELECT id, class_id FROM cat WHERE category <> 'Normal'"))
def _p11(spark, sf):
    from ..operators.prep import attack_probes

    return attack_probes(fl.encode_category(fl.categorise(st.flows(spark, sf))), CLASSES.index("Normal")).select("id", "class_id")


@query("P12_confident_probes", sql("scored", """
  SELECT id, round(list_max(probs), 6) AS confidence FROM (SELECT * FROM scored ORDER BY id LIMIT 100) WHERE list_max(probs) > 0.7"""))
def _p12(spark, sf):
    return fl.confident_probes(st.scored(spark, sf), "id", "probs").select("id", F.round(F.array_max("probs"), 6).alias("confidence"))


@query("P13_representative_case", sql("cat", """
  SELECT category, id, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY (confidence >= 0.85 AND confidence < 0.95) DESC,
      CASE WHEN confidence >= 0.85 AND confidence < 0.95 THEN id END, confidence DESC, id) AS r FROM cat) WHERE r = 1"""))
def _p13(spark, sf):
    cat = fl.categorise(st.flows(spark, sf)).select("id", "category", "confidence")
    return fl.representative_case(cat, "confidence", "id", by=("category",)).select("category", "id", "confidence")


# --- A1-A7, W1, W5, W6, T1: exploration -----------------------------------------------------------

@query("A1_category_shares", sql("cat", """
  SELECT category, count(*) AS rows, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share_pct FROM cat GROUP BY 1"""))
def _a1(spark, sf):
    return fl.counts_with_share(fl.categorise(st.flows(spark, sf)), "category")


@query("A2_protocol_by_category", sql("cat", "SELECT protocol_type, " + ", ".join(
    f"count(*) FILTER (category = '{c}') AS {c}" for c in CLASSES) + " FROM cat GROUP BY 1"))
def _a2(spark, sf):
    return fl.protocol_by_category(fl.categorise(st.flows(spark, sf)))


@query("A3_smallest_variances", sql("flows", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_samp({c}), 6) AS variance FROM flows" for c in _NUM) + ") ORDER BY variance, 1 LIMIT 5"))
def _a3(spark, sf):
    return fl.smallest_variances(st.flows(spark, sf), _NUM, 5).withColumn("variance", F.round("variance", 6))


@query("A3_wide_variances", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_samp({c}), 4) AS variance FROM lineitem" for c in _WIDE) + ")")
def _a3w(spark, sf):
    return fl.column_variances(st.table(spark, sf, "lineitem"), _WIDE).withColumn("variance", F.round("variance", 4))


_CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


@query("A4_label_correlations", sql("cat", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round({_CORR.format(a=c, b='class_id')}, 6) AS correlation FROM cat" for c in _NUM)))
def _a4(spark, sf):
    cat = fl.encode_category(fl.categorise(st.flows(spark, sf)))
    return fl.label_correlations(cat, _NUM, "class_id").withColumn("correlation", F.round("correlation", 6))


@query("A5_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round({_CORR.format(a=a, b=b)}, 6) AS correlation FROM lineitem" for a in _WIDE for b in _WIDE))
def _a5(spark, sf):
    return fl.correlation_matrix(st.table(spark, sf, "lineitem"), _WIDE).withColumn("correlation", F.round("correlation", 6))


_STRONG = [*_NUM, "class_id"]


@query("A5_strongest_matrix", sql("cat", f"""
  WITH l AS (SELECT unnest([{', '.join(f"'{c}'" for c in _NUM)}]) AS name, unnest([{', '.join(_CORR.format(a=c, b='class_id') for c in _NUM)}]) AS r FROM cat),
  top AS (SELECT name FROM (FROM l ORDER BY abs(r) DESC NULLS LAST, name LIMIT 15) UNION ALL SELECT 'class_id'),
  u AS (SELECT id, unnest([{', '.join(f"'{c}'" for c in _STRONG)}]) AS name, unnest([{', '.join(f'{c}::DOUBLE' for c in _STRONG)}]) AS v FROM cat),
  t AS (FROM u SEMI JOIN top USING (name))
  SELECT x.name AS a, y.name AS b, round({_CORR.format(a='x.v', b='y.v')}, 6) AS correlation FROM t x JOIN t y USING (id) GROUP BY 1, 2"""))
def _a5_strongest(spark, sf):
    cat = fl.encode_category(fl.categorise(st.flows(spark, sf)))
    return fl.strongest_matrix(cat, _NUM, "class_id").withColumn("correlation", F.round("correlation", 6))


@query("T1_top_correlated", sql("cat", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round({_CORR.format(a=c, b='class_id')}, 6) AS correlation FROM cat" for c in _NUM)
    + ") ORDER BY abs(correlation) DESC NULLS LAST, 1 LIMIT 3"))
def _t1(spark, sf):
    cat = fl.encode_category(fl.categorise(st.flows(spark, sf)))
    rounded = fl.label_correlations(cat, _NUM, "class_id").withColumn("correlation", F.round("correlation", 6))
    return fl.top_correlated(rounded, 3).drop("strength")


@query("A6_class_counts", sql("cat", "SELECT split, category, count(*) AS rows FROM cat GROUP BY 1, 2"))
def _a6(spark, sf):
    return fl.class_counts(fl.categorise(st.flows(spark, sf)), ("split", "category"))


@query("A7_class_shortfall", sql("cat", """
  SELECT category, count(*) AS rows, max(count(*)) OVER () AS majority, max(count(*)) OVER () - count(*) AS shortfall FROM cat GROUP BY 1"""))
def _a7(spark, sf):
    return fl.class_shortfall(fl.categorise(st.flows(spark, sf)), "category")


@query("W1_top_services", sql("cat", """
  SELECT category, service, rows, place FROM (SELECT category, service, count(*) AS rows,
    CAST(row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, service) AS INT) AS place
    FROM cat WHERE category <> 'Normal' GROUP BY 1, 2) WHERE place <= 5"""))
def _w1(spark, sf):
    return fl.top_values(fl.categorise(st.flows(spark, sf)).filter("category <> 'Normal'"), "category", "service")


@query("W5_first_row", sql("cat", """
  SELECT category, min(id) AS id, arg_min(service, id) AS service FROM cat WHERE confidence > 0.5 GROUP BY 1"""))
def _w5(spark, sf):
    cat = fl.categorise(st.flows(spark, sf)).select("category", "id", "service", "confidence")
    return fl.first_row(cat, "id", F.col("confidence") > 0.5, ("category",)).select("category", "id", "service")


@query("W6_most_confident", sql("cat", """
  SELECT category, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, id) AS r FROM cat) WHERE r = 1"""))
def _w6(spark, sf):
    return fl.most_confident(fl.categorise(st.flows(spark, sf)).select("category", "id", "confidence"), "category", "confidence", "id")


@query("J12_align_columns", sql("flows", "SELECT id, CAST(count AS BIGINT) AS count, 0 AS absent FROM flows"))
def _j12(spark, sf):
    from ..operators.prep import align

    return align(st.flows(spark, sf), ("id", "count", "absent")).select("id", F.col("count").cast("bigint").alias("count"), "absent")


@query("J13_known_labels", sql("flows tax", "SELECT id, label FROM flows WHERE label IN (SELECT label FROM tax)"))
def _j13(spark, sf):
    return fl.known_rows(st.flows(spark, sf)).select("id", "label")


# --- A8-A17, T2: metrics ------------------------------------------------------------------------

_PER_CLASS = """
  g AS (SELECT DISTINCT model, split FROM preds), c AS (SELECT model, split, y AS class_id FROM preds UNION SELECT model, split, p FROM preds),
  s AS (SELECT c.model, c.split, c.class_id, count(*) FILTER (q.y = c.class_id AND q.p = c.class_id) AS tp,
               count(*) FILTER (q.y = c.class_id) AS support, count(*) FILTER (q.p = c.class_id) AS predicted
        FROM c JOIN preds q USING (model, split) GROUP BY 1, 2, 3),
  k AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS re,
               coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1 FROM s)
"""


def _counts(spark, sf):
    return mt.confusion_counts(st.predictions(spark, sf))


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("A8_accuracy", sql("preds", "SELECT model, split, round(avg(CAST(y = p AS DOUBLE)), 6) AS accuracy FROM preds GROUP BY 1, 2"))
def _a8(spark, sf):
    return _rounded(mt.scores(_counts(spark, sf)), "accuracy").select("model", "split", "accuracy")


@query("A9_f1", sql("preds", f"""
  WITH {_PER_CLASS} SELECT model, split, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM k GROUP BY 1, 2"""))
def _a9(spark, sf):
    return _rounded(mt.scores(_counts(spark, sf)), "f1_macro", "f1_weighted").select("model", "split", "f1_macro", "f1_weighted")


@query("A10_class_report", sql("preds", f"""
  WITH {_PER_CLASS}
  SELECT model, split, CAST(class_id AS VARCHAR) AS "row", round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1, support FROM k
  UNION ALL SELECT model, split, 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM k GROUP BY 1, 2
  UNION ALL SELECT model, split, 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM k GROUP BY 1, 2"""))
def _a10(spark, sf):
    return _rounded(mt.report(_counts(spark, sf)), "precision", "recall", "f1")


@query("A11_confusion_matrix", sql("preds", """
  WITH g AS (SELECT * FROM (SELECT DISTINCT model, split FROM preds), range(5) a(y), range(5) b(p)),
  n AS (SELECT g.model, g.split, CAST(g.y AS INT) AS y, CAST(g.p AS INT) AS p, count(q.id) AS n FROM g
        LEFT JOIN preds q ON q.model = g.model AND q.split = g.split AND q.y = g.y AND q.p = g.p GROUP BY 1, 2, 3, 4)
  SELECT *, round(n / greatest(sum(n) OVER (PARTITION BY model, split, y), 1)::DOUBLE, 6) AS share FROM n"""))
def _a11(spark, sf):
    return _rounded(mt.confusion_matrix(_counts(spark, sf), 5), "share")


def _binary(spark, sf):
    normal = CLASSES.index("Normal")
    return st.predictions(spark, sf).select(
        "model", (F.col("y") != normal).cast("int").alias("y"), (F.col("p") != normal).cast("int").alias("p"))


_BIN = """b AS (SELECT model, y <> 1 AS y, p <> 1 AS p FROM preds),
  c AS (SELECT model, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (NOT y AND p) AS fp,
               count(*) FILTER (y AND NOT p) AS fn FROM b GROUP BY 1)"""
_BIN_SCORES = """SELECT model, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE * 100, 2) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE * 100, 2) AS "precision",
  round(tp / nullif(tp + fn, 0)::DOUBLE * 100, 2) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE * 100, 2) AS f1_score FROM c"""


@query("A12_binary_counts", sql("preds", f"WITH {_BIN} SELECT * FROM c"))
def _a12(spark, sf):
    return mt.binary_counts(_binary(spark, sf))


@query("A13_binary_scores", sql("preds", f"WITH {_BIN} {_BIN_SCORES}"))
def _a13(spark, sf):
    return mt.binary_scores(mt.binary_counts(_binary(spark, sf)))


_SCORES = f"""{_PER_CLASS}, t AS (SELECT model, split, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(f1) AS f1_macro,
  sum(f1 * support) / sum(support) AS f1_weighted FROM k GROUP BY 1, 2)"""
_OF = "max(CASE WHEN split = '{s}' THEN {m} END)"


@query("A14_score_pivot", sql("preds", f"WITH {_SCORES} SELECT model, " + ", ".join(
    f"round({_OF.format(s=s, m=m)}, 4) AS {m}_{s}" for m in ("accuracy", "f1_macro", "f1_weighted") for s in ("test", "val")) + " FROM t GROUP BY 1"))
def _a14(spark, sf):
    return mt.score_pivot(mt.scores(_counts(spark, sf)))


@query("A15_split_gap", sql("preds", f"WITH {_SCORES} SELECT model, " + ", ".join(
    f"round({_OF.format(s='val', m=m)} - {_OF.format(s='test', m=m)}, 4) AS {m}_gap" for m in ("accuracy", "f1_macro", "f1_weighted")) + " FROM t GROUP BY 1"))
def _a15(spark, sf):
    return mt.split_gap(mt.scores(_counts(spark, sf)))


@query("A16_detected", sql("preds", f"WITH {_BIN} SELECT model, count(*) FILTER (p) AS attacks, count(*) AS rows FROM b GROUP BY 1"))
def _a16(spark, sf):
    return mt.detected(_binary(spark, sf))


@query("A17_comparison", sql("preds", f"WITH {_BIN}, s AS ({_BIN_SCORES}) " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, " + ", ".join(f"max(CASE WHEN model = '{x}' THEN \"{m}\" END) AS {x}" for x in ("m0", "m1", "m2")) + " FROM s"
    for m in ("accuracy", "precision", "recall", "f1_score"))))
def _a17(spark, sf):
    return mt.comparison(mt.binary_scores(mt.binary_counts(_binary(spark, sf))), ("m0", "m1", "m2"))


@query("T2_best_model", sql("preds", f"WITH {_SCORES} SELECT model, round(f1_macro, 6) AS f1_macro FROM t WHERE split = 'test' ORDER BY t.f1_macro DESC, model LIMIT 1"))
def _t2(spark, sf):
    return _rounded(mt.best_model(mt.scores(_counts(spark, sf))), "f1_macro").select("model", "f1_macro")


@query("K2_results_json", sql("preds", f"""
  WITH {_SCORES} SELECT '{{"model":"' || model || '","split":"' || split || '","accuracy":' || round(accuracy, 4) || ',"f1_macro":' || round(f1_macro, 4) ||
  ',"f1_weighted":' || round(f1_weighted, 4) || '}}' AS line FROM t"""))
def _k2(spark, sf):
    from ..sinks import score_json

    path = st.scratch(spark, "results")
    score_json(mt.scores(_counts(spark, sf))).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- J3, J4, C17-C21, N1-N5: decisions ------------------------------------------------------------

@query("J3_host_role", sql("flows hosts", "SELECT id, destination_ip, coalesce(role, 'unprotected') AS destination_role FROM flows LEFT JOIN hosts ON ip = destination_ip"))
def _j3(spark, sf):
    return dc.with_host_role(st.flows(spark, sf).select("id", "destination_ip")).select("id", "destination_ip", "destination_role")


_BUCKET = """CASE WHEN {c} >= 0.95 AND {c} < 1.01 THEN 'CRITICAL' WHEN {c} >= 0.85 AND {c} < 0.95 THEN 'HIGH' WHEN {c} >= 0.70 AND {c} < 0.85 THEN 'MEDIUM' ELSE 'LOW' END"""
_ACTION = "CASE {s} WHEN 'LOW' THEN 'ALERT_ONLY' WHEN 'MEDIUM' THEN 'FLAG_FOR_REVIEW' WHEN 'HIGH' THEN 'BLOCK_IP' ELSE 'ISOLATE_HOST' END"


@query("J4_severity_bucket", sql("flows", f"SELECT id, confidence, {_BUCKET.format(c='confidence')} AS severity FROM flows"))
def _j4(spark, sf):
    return st.flows(spark, sf).select("id", "confidence", dc.severity_bucket(F.col("confidence")).alias("severity"))


@query("J4_severity_range_join", sql("flows", f"SELECT id, {_BUCKET.format(c='confidence')} AS severity FROM flows"))
def _j4j(spark, sf):
    from ..dims import decision_matrix

    return dc.severity_bucket_join(st.flows(spark, sf).select("id", "confidence"), decision_matrix(spark)).select("id", "severity")


@query("C19_strict_severity", sql("flows", """
  SELECT id, CASE WHEN confidence > 0.95 THEN 'CRITICAL' WHEN confidence > 0.85 THEN 'HIGH' WHEN confidence > 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM flows"""))
def _c19(spark, sf):
    return st.flows(spark, sf).select("id", dc.strict_severity(F.col("confidence")).alias("severity"))


@query("C17_iso_utc", "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS moment FROM events")
def _c17(spark, sf):
    return st.events(spark, sf).select("id", iso_utc(F.col("ts")).alias("moment"))


@query("C18_rounding", "SELECT event_id AS id, round(sqrt(value), 4) AS metric, round(sqrt(value), 2) AS percent, round(sqrt(value), 1) AS secs FROM events")
def _c18(spark, sf):
    x = F.sqrt("v")
    return st.events(spark, sf).select("id", F.round(x, 4).alias("metric"), F.round(x, 2).alias("percent"), F.round(x, 1).alias("secs"))


_DECIDE = f"""
  d AS (SELECT s.id, s.destination_ip, coalesce(role, 'unprotected') AS destination_role,
               (['DoS', 'Normal', 'Probe', 'R2L', 'U2R'])[list_position(probs, list_max(probs))] AS prediction, list_max(probs) AS c, ts
        FROM scored s LEFT JOIN hosts ON ip = destination_ip),
  e AS (SELECT *, prediction <> 'Normal' AS is_attack, CASE WHEN prediction <> 'Normal' THEN {_BUCKET.format(c='c')} ELSE 'LOW' END AS severity,
               prediction <> 'Normal' AND destination_role <> 'unprotected' AS safety_triggered FROM d),
  n1 AS (SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", destination_ip, destination_role, prediction, round(c, 4) AS confidence, is_attack, severity,
               CASE WHEN safety_triggered THEN 'HUMAN_REVIEW_REQUIRED' ELSE {_ACTION.format(s='severity')} END AS action, safety_triggered FROM e)
"""


def _decided(spark, sf):
    return dc.decide(st.scored(spark, sf).drop("k", "label"), F.col("ts")).drop("ts")


@query("N1_decide", sql("scored hosts", f"WITH {_DECIDE} SELECT * FROM n1"))
def _n1(spark, sf):
    return _decided(spark, sf)


@query("N1_decide_stream", sql("scored hosts", f"""WITH {_DECIDE} SELECT id, destination_ip, prediction, confidence, severity, action, safety_triggered FROM n1"""))
def _n1s(spark, sf):
    from ..streaming.decisions import start_decision_log

    path = st.scratch(spark, "scored")
    st.scored(spark, sf).drop("k", "label", "ts").write.parquet(path)
    out = st.scratch(spark, "decisions")
    arriving = spark.readStream.schema("id bigint, destination_ip string, probs array<double>").parquet(path)
    start_decision_log(arriving, out, st.scratch(spark, "progress"), available_now=True).awaitTermination()
    return spark.read.parquet(out).select("id", "destination_ip", "prediction", "confidence", "severity", "action", "safety_triggered")


@query("N2_decide_binary", sql("cat hosts", f"""
  SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", destination_ip, confidence, confidence > 0.5 AS is_attack, category AS attack_type,
    CASE WHEN confidence > 0.5 THEN {_BUCKET.format(c='confidence')} ELSE 'LOW' END AS severity,
    CASE WHEN role IS NOT NULL THEN 'HUMAN_REVIEW_REQUIRED' ELSE {_ACTION.format(s="(CASE WHEN confidence > 0.5 THEN " + _BUCKET.format(c='confidence') + " ELSE 'LOW' END)")} END AS action_taken,
    role IS NOT NULL AS safety_triggered
  FROM cat LEFT JOIN hosts ON ip = destination_ip"""))
def _n2(spark, sf):
    cat = fl.categorise(st.flows(spark, sf)).select("id", "ts", "destination_ip", "confidence", F.col("category").alias("attack_type"))
    return dc.decide_binary(cat, F.col("ts")).drop("ts", "reasoning")


@query("N3_safety_filter", sql("flows hosts", f"""
  SELECT id, destination_ip, role IS NOT NULL AS blocked,
    CASE WHEN role IS NOT NULL THEN 'SAFETY FILTER: ' || destination_ip || ' is critical infrastructure' ELSE '{dc.NOT_PROTECTED}' END AS reason,
    CASE WHEN role IS NOT NULL THEN {_ACTION.format(s='(' + _BUCKET.format(c='confidence') + ')')} END AS original,
    CASE WHEN role IS NOT NULL THEN 'HUMAN_REVIEW_REQUIRED' ELSE {_ACTION.format(s='(' + _BUCKET.format(c='confidence') + ')')} END AS action
  FROM flows LEFT JOIN hosts ON ip = destination_ip"""))
def _n3(spark, sf):
    asked = st.flows(spark, sf).select("id", "destination_ip", dc.action_for(dc.severity_bucket(F.col("confidence"))).alias("action"))
    return dc.safety_filter(asked)


@query("N4_action_summary", sql("scored hosts", f"WITH {_DECIDE} SELECT severity, action, count(*) AS decisions FROM n1 GROUP BY 1, 2"))
def _n4(spark, sf):
    return dc.action_summary(_decided(spark, sf))


@query("N4_decision_log", sql("scored hosts", f"WITH {_DECIDE} SELECT id, severity, action FROM n1"))
def _n4l(spark, sf):
    from ..operators.history import append_decisions

    path = st.scratch(spark, "log")
    decided = _decided(spark, sf)
    append_decisions(decided.filter("safety_triggered"), path)
    append_decisions(decided.filter("NOT safety_triggered"), path)
    return spark.read.parquet(path).select("id", "severity", "action")


def _sql_text(text):
    return "'" + text.replace("'", "''") + "'"


def _reasoning_sql(kind, severity, conf):
    shown = f"printf('%.2f', {conf})"
    part = lambda t: " || ".join(_sql_text(p) for p in [t])
    cases = " ".join(f"WHEN '{k}' THEN replace(replace({part(t)}, '%.2f', {shown}), '{{severity}}', {severity})" for k, t in dc.REASONING.items())
    return f"CASE {kind} {cases} ELSE replace({part(dc.UNKNOWN_REASONING)}, '%.2f', {shown}) END"


@query("C21_reasoning", sql("flows tax", "SELECT id, " + _reasoning_sql("coalesce(category, 'Unknown')", _BUCKET.format(c='c'), "c")
                            + " AS reasoning FROM (SELECT *, CAST((id * 37 + k) % 101 AS DOUBLE) / 100 AS c FROM flows) LEFT JOIN tax USING (label)"))
def _c21(spark, sf):
    cat = fl.categorise(st.flows(spark, sf), default="Unknown")
    c = ((F.col("id") * 37 + F.col("k")) % 101).cast("double") / 100  # two decimals: nothing left to round
    return cat.select("id", dc.reasoning(F.col("category"), dc.severity_bucket(c), c).alias("reasoning"))


_ALERT = "CASE WHEN category = 'Probe' THEN {p} ELSE {d} END"


@query("C20_alert_narrative", sql("cat", "SELECT id, " + _ALERT.format(p=_sql_text(dc.ALERT_TEXT["Probe"][0]), d=_sql_text(dc.ALERT_TEXT["DoS"][0]))
    + " || chr(10) || 'count: ' || count || ' (importance: 0.5)' AS narrative, "
    + _ALERT.format(p=_sql_text("; ".join(dc.ALERT_TEXT["Probe"][1])), d=_sql_text("; ".join(dc.ALERT_TEXT["DoS"][1]))) + " AS mitigation FROM cat WHERE category <> 'Normal'"))
def _c20(spark, sf):
    return _alerts(spark, sf).select("id", "narrative", F.array_join("mitigation", "; ").alias("mitigation"))


def _alerts(spark, sf):
    features = F.create_map(F.lit("count"), F.struct(F.col("count").alias("value"), F.lit(0.5).alias("importance")))
    cases = fl.categorise(st.flows(spark, sf)).filter("category <> 'Normal'").select(
        "id", F.col("category").alias("attack_type"), "confidence", features.alias("features"))
    return dc.alert_reports(cases)


@query("N5_alert_report", sql("cat", """
  SELECT id, category AS attack_type, CASE WHEN confidence > 0.95 THEN 'CRITICAL' WHEN confidence > 0.85 THEN 'HIGH' WHEN confidence > 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS alert_severity,
    printf('%.2f%%', confidence * 100) AS confidence_pct, 'ALERT GENERATED - AWAITING ANALYST REVIEW' AS status FROM cat WHERE category <> 'Normal'"""))
def _n5(spark, sf):
    return _alerts(spark, sf).select("id", "attack_type", "alert_severity", "confidence_pct", "status")


_TOP = (("count", 0.12), ("dst_bytes", 0.05))
_CASE_FEATURES = ",".join(f"""{{"name":"{n}","value":' || round(CAST({n} AS DOUBLE), 4) || ',"importance":{w}}}""" for n, w in _TOP)
_MATRIX_JSON = ",".join(f'{{"lo":{lo},"hi":{hi},"severity":"{s}","action":"{a}"}}' for s, lo, hi, a in DECISION_MATRIX)


@query("K3_case_document", sql("cat", """
  WITH c AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY (confidence >= 0.85 AND confidence < 0.95) DESC,
      CASE WHEN confidence >= 0.85 AND confidence < 0.95 THEN id END, confidence DESC, id) AS r FROM cat WHERE category IN ('DoS', 'Probe')) WHERE r = 1)
  SELECT '{"top_features":[""" + ",".join(f'{{"feature":"{n}","score":{w}}}' for n, w in _TOP) + """],"cases":[' || string_agg(
    '{"category":"' || category || '","index":' || id || ',"confidence":' || confidence || ',"severity":"' ||
    CASE WHEN confidence > 0.95 THEN 'CRITICAL' WHEN confidence > 0.85 THEN 'HIGH' WHEN confidence > 0.7 THEN 'MEDIUM' ELSE 'LOW' END ||
    '","features":[""" + _CASE_FEATURES + """]}', ',' ORDER BY category) || '],"decision_matrix":[""" + _MATRIX_JSON + """]}' AS value FROM c"""))
def _k3_document(spark, sf):
    from ..dims import decision_matrix
    from ..operators.explain import case_features
    from ..sinks import case_document

    cat = fl.categorise(st.flows(spark, sf)).filter(F.col("category").isin("DoS", "Probe"))
    numbers = F.array(*[F.col(n).cast("double") for n, _ in _TOP])
    known = cat.select("category", "id", "confidence", case_features(numbers, [(n, j, w) for j, (n, w) in enumerate(_TOP)]).alias("features"))
    cases = fl.representative_case(known, "confidence", "id", by=("category",)).select(
        "category", F.col("id").alias("index"), "confidence", dc.strict_severity(F.col("confidence")).alias("severity"), "features")
    top = spark.createDataFrame(list(_TOP), "feature string, importance double")
    return case_document(top, cases, decision_matrix(spark))


@query("K3_decision_json", sql("scored hosts", f"""
  WITH {_DECIDE} SELECT id, '{{"destination_ip":"' || destination_ip || '","prediction":"' || prediction || '","confidence":' || confidence || ',"severity":"' ||
    severity || '","action":"' || action || '"}}' AS line FROM n1"""))
def _k3(spark, sf):
    from ..sinks import decision_json

    return decision_json(_decided(spark, sf).select("id", "destination_ip", "prediction", "confidence", "severity", "action"), "id")
