"""Registered queries: findings algebra, evaluation, history and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import SCENARIOS
from ..functions import severity as sev
from ..functions import text as tx
from ..operators import evalscore as ev
from ..operators import export as ex
from ..operators import findings as fg
from ..operators import history as hs
from . import standins as st
from .registry import query
from .standins import sql

_LADDER = "['info', 'low', 'medium', 'high', 'critical']"
_DOWN = "CASE WHEN {r} <= 1 THEN {s} ELSE (" + _LADDER + ")[CAST(greatest({r} - {n}, 1) + 1 AS INT)] END"


# --- X, P16, P17, W4: sets and dedupe -------------------------------------------------------------

@query("X1_union_findings", sql("fi", """SELECT run_id, seq, rule_id FROM fi WHERE et = 'view' UNION ALL SELECT run_id, seq, rule_id FROM fi WHERE et <> 'error'"""))
def _x1(spark, sf):
    from ..operators.rules import union_findings

    f = st.findings(spark, sf)
    return union_findings(f.filter("et = 'view'"), f.filter("et <> 'error'")).select("run_id", "seq", "rule_id")


@query("X2_multiset_difference", sql("fi", """
  WITH e AS (SELECT file, rule_id, count(*) AS n FROM fi WHERE et <> 'click' GROUP BY 1, 2), a AS (SELECT file, rule_id, count(*) AS n FROM fi WHERE et <> 'view' GROUP BY 1, 2)
  SELECT file, rule_id, least(coalesce(e.n, 0), coalesce(a.n, 0)) AS both_n, greatest(coalesce(a.n, 0) - coalesce(e.n, 0), 0) AS only_actual,
         greatest(coalesce(e.n, 0) - coalesce(a.n, 0), 0) AS only_expected FROM e FULL JOIN a USING (file, rule_id)"""))
def _x2(spark, sf):
    f = st.findings(spark, sf)
    return ev.multiset_score(f.filter("et <> 'click'"), f.filter("et <> 'view'")).select(
        "file", "rule_id", F.col("tp").alias("both_n"), F.col("fp").alias("only_actual"), F.col("fn").alias("only_expected"))


@query("X3_rule_sets", sql("fi scen", """
  WITH f AS (SELECT DISTINCT run_id, rule_id FROM fi)
  SELECT run_id, scenario_id, count(*) FILTER (needed = 1 AND f.rule_id IS NOT NULL) = max(n_required) AS contained,
         count(*) FILTER (needed = 0 AND f.rule_id IS NOT NULL) AS shared, count(*) AS united
  FROM (SELECT DISTINCT run_id FROM f) r CROSS JOIN scen LEFT JOIN f USING (run_id, rule_id) GROUP BY 1, 2"""))
def _x3(spark, sf):
    from ..dims import scenarios

    named = sorted({r for s in SCENARIOS for r in s[1] + s[2]})
    sets = fg.fired_rules(st.findings(spark, sf)).groupBy("run_id").agg(  # at most the rules the scenarios name
        F.collect_set(F.when(F.col("rule_id").isin(named), F.col("rule_id"))).alias("fired"))
    return sets.crossJoin(scenarios(spark)).select(  # three scenarios
        "run_id", "scenario_id", (F.size(F.array_except("required", "fired")) == 0).alias("contained"),
        F.size(F.array_intersect("amplifiers", "fired")).cast("bigint").alias("shared"),
        F.size(F.array_union("required", "amplifiers")).cast("bigint").alias("united"))


@query("P16_blocking", sql("fi", "SELECT run_id, bool_or(severity IN ('high', 'critical')) AS blocking FROM fi GROUP BY 1"))
def _p16(spark, sf):
    return st.findings(spark, sf).groupBy("run_id").agg(F.bool_or(sev.is_blocking(F.col("severity"))).alias("blocking"))


@query("P17_bucket_by_check", sql("fi", 'SELECT run_id, "check", count(*) AS findings FROM fi GROUP BY 1, 2'))
def _p17(spark, sf):
    return fg.bucket_by_check(st.findings(spark, sf))


@query("W4_keep_first", sql("fi", """
  SELECT run_id, seq, rule_id, file, line_start FROM fi WHERE line_start IS NULL
  UNION ALL SELECT run_id, min(seq), rule_id, file, line_start FROM fi WHERE line_start IS NOT NULL GROUP BY run_id, rule_id, file, line_start"""))
def _w4(spark, sf):
    return fg.keep_first(st.findings(spark, sf), F.col("seq")).select("run_id", "seq", "rule_id", "file", "line_start")


# --- A18, A19, A24-A26, T5, T6: summaries ---------------------------------------------------------

@query("A18_run_summary", sql("fi sev", """
  SELECT run_id, count(*) AS total_findings, arg_max(severity, rnk) AS max_severity, max(rnk) >= 3 AS blocking FROM fi JOIN sev USING (severity) GROUP BY 1"""))
def _a18(spark, sf):
    return fg.run_summary(st.findings(spark, sf))


_A19 = """SELECT run_id, "check", count(rule_id) AS findings, arg_max(severity, rnk) AS max_severity, duration_ms,
  CASE WHEN count(rule_id) > 0 THEN 'issues' WHEN tool_status <> 'ok' THEN tool_status ELSE 'clean' END AS status
  FROM cr LEFT JOIN (SELECT run_id, "check", rule_id, severity, rnk FROM fi JOIN sev USING (severity)) USING (run_id, "check") GROUP BY run_id, "check", duration_ms, tool_status"""


@query("A19_check_summary", sql("fi sev cr", _A19))
def _a19(spark, sf):
    return fg.check_summary(st.findings(spark, sf), st.check_runs(spark, sf))


@query("A24_fired_rules", sql("fi", "SELECT run_id, rule_id, count(*) AS detections FROM fi GROUP BY 1, 2"))
def _a24(spark, sf):
    return fg.fired_rules(st.findings(spark, sf))


@query("A25_run_delta", sql("fi", """
  SELECT "check", count(*) FILTER (run_id = 'run-1') AS before, count(*) FILTER (run_id = 'run-8') AS after,
         count(*) FILTER (run_id = 'run-8') - count(*) FILTER (run_id = 'run-1') AS delta,
         round((count(*) FILTER (run_id = 'run-8') - count(*) FILTER (run_id = 'run-1')) * 100.0::DOUBLE / nullif(count(*) FILTER (run_id = 'run-1'), 0), 2) AS delta_pct
  FROM fi WHERE run_id IN ('run-1', 'run-8') GROUP BY 1"""))
def _a25(spark, sf):
    return fg.run_delta(st.findings(spark, sf), "run-1", "run-8")


@query("A26_rule_counts", sql("fi", "SELECT rule_id, file, count(*) AS detections FROM fi GROUP BY 1, 2"))
def _a26(spark, sf):
    return fg.rule_counts(st.findings(spark, sf))


@query("T5_finding_order", sql("fi sev", """
  SELECT seq, rule_id, CAST(row_number() OVER (PARTITION BY run_id, "check" ORDER BY rnk DESC, rule_id, file, coalesce(line_start, 0), seq) AS BIGINT) AS place, run_id
  FROM fi JOIN sev USING (severity)"""))
def _t5(spark, sf):
    from ..functions.ordering import number_rows

    order = [F.col("run_id"), F.col("check"), *fg.finding_order(), F.col("seq")]
    numbered = number_rows(st.findings(spark, sf), order, "n")
    first = numbered.groupBy("run_id", "check").agg(F.min("n").alias("first"))
    return numbered.join(first, ["run_id", "check"]).select("seq", "rule_id", (F.col("n") - F.col("first") + 1).alias("place"), "run_id")


@query("T6_check_order", sql("fi sev cr", f"""
  WITH a AS ({_A19}) SELECT run_id, "check", CAST(row_number() OVER (PARTITION BY run_id ORDER BY coalesce(rnk, 0) DESC, "check") AS INT) AS place
  FROM a LEFT JOIN sev ON sev.severity = a.max_severity"""))
def _t6(spark, sf):
    from pyspark.sql import Window

    summary = fg.check_summary(st.findings(spark, sf), st.check_runs(spark, sf))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(*fg.check_order()))  # a handful of checks per run
    return summary.select("run_id", "check", place.alias("place"))


# --- J7, W8, R18: scenarios -----------------------------------------------------------------------

_SCEN = f"""
  f AS (SELECT run_id, rule_id, min(seq) AS s, arg_min(file, seq) AS file FROM fi GROUP BY 1, 2),
  m AS (SELECT run_id, scenario_id, baseline, name, n_required, narrative, count(*) FILTER (needed = 1) AS hits, count(*) FILTER (needed = 0) AS amp,
               arg_min(file, s) FILTER (needed = 1) AS anchor, string_agg(rule_id, ', ' ORDER BY rule_id) AS chained
        FROM f JOIN scen USING (rule_id) GROUP BY 1, 2, 3, 4, 5, 6),
  sc AS (SELECT *, ({_LADDER})[CAST(least(3 + amp, 4) + 1 AS INT)] AS severity FROM m WHERE hits = n_required)
"""


@query("J7_scenario_match", sql("fi scen", f"WITH {_SCEN} SELECT run_id, scenario_id AS rule_id FROM sc"))
def _j7(spark, sf):
    return fg.synthesise_scenarios(st.findings(spark, sf)).select("run_id", "rule_id")


@query("W8_scenario_anchor", sql("fi scen", f"WITH {_SCEN} SELECT run_id, scenario_id AS rule_id, anchor AS file FROM sc"))
def _w8(spark, sf):
    return fg.synthesise_scenarios(st.findings(spark, sf)).select("run_id", "rule_id", "file")


@query("R18_scenarios", sql("fi scen", f"""
  WITH {_SCEN} SELECT run_id, scenario_id AS rule_id, severity, name || '. ' || narrative || ' (amplifiers triggered: ' || amp || ')' AS message,
    'chained findings: ' || chained AS evidence FROM sc"""))
def _r18(spark, sf):
    return fg.synthesise_scenarios(st.findings(spark, sf)).select("run_id", "rule_id", "severity", "message", "evidence")


@query("R18_scenarios_per_file", sql("fi scen", f"""
  WITH {_SCEN.replace("SELECT run_id, rule_id, min(seq) AS s, arg_min(file, seq) AS file FROM fi GROUP BY 1, 2", "SELECT run_id, file AS own, rule_id, min(seq) AS s, min(file) AS file FROM fi GROUP BY 1, 2, 3")
       .replace("SELECT run_id, scenario_id, baseline", "SELECT run_id, own, scenario_id, baseline").replace("GROUP BY 1, 2, 3, 4, 5, 6)", "GROUP BY 1, 2, 3, 4, 5, 6, 7)")}
  SELECT run_id, own AS nb, scenario_id AS rule_id, severity FROM sc"""))
def _r18f(spark, sf):
    f = st.findings(spark, sf).withColumn("nb", F.col("file"))
    return fg.synthesise_scenarios(f, ("run_id", "nb")).select("run_id", "nb", "rule_id", "severity")


# --- J10, J11, R20, R21, C10, C23: adjudication ---------------------------------------------------

_MATCH = """
  t AS (SELECT run_id, rule_id, file, line_start, min(seq) AS seq FROM fi GROUP BY 1, 2, 3, 4),
  mv AS (SELECT v.*, t.seq FROM vd v LEFT JOIN t ON t.run_id = v.run_id AND t.rule_id = v.rule_id AND t.file = v.file AND t.line_start IS NOT DISTINCT FROM v.line_start)
"""


@query("J10_match_verdicts", sql("vd fi", f"WITH {_MATCH} SELECT run_id, ord, seq, CASE WHEN seq IS NULL THEN 'unknown_finding' END AS error FROM mv"))
def _j10(spark, sf):
    matched = fg.match_verdicts(st.verdicts(spark, sf), st.findings(spark, sf))
    return matched.select("run_id", "ord", "seq", F.when(F.col("seq").isNull(), "unknown_finding").alias("error"))


@query("R20_adjudicate", sql("vd fi sev", f"""
  WITH {_MATCH}, e AS (SELECT run_id, seq, count(*) AS verdicts, count(*) FILTER (NOT confirmed) AS rej, bool_or(confirmed AND confidence = 'high') AS sure FROM mv WHERE seq IS NOT NULL GROUP BY 1, 2)
  SELECT f.run_id, f.seq, {_DOWN.format(r='rnk', s='f.severity', n='coalesce(rej, 0)')} AS severity,
         CASE WHEN has_fix THEN CASE WHEN sure THEN 'high' ELSE fix_confidence END END AS fix_confidence, coalesce(verdicts, 0) AS verdicts
  FROM fi f JOIN sev ON sev.severity = f.severity LEFT JOIN e ON e.run_id = f.run_id AND e.seq = f.seq"""))
def _r20(spark, sf):
    return fg.adjudicate(st.findings(spark, sf), st.verdicts(spark, sf)).select(
        "run_id", "seq", "severity", F.col("fix.confidence").alias("fix_confidence"), "verdicts")


@query("C23_verdict_evidence", sql("vd fi", f"""
  WITH {_MATCH} SELECT run_id, seq, ord, chr(10) || '[LLM judgement] confirmed=' || CASE WHEN confirmed THEN 'True' ELSE 'False' END || ' confidence=' || confidence || ': ' || reasoning AS added
  FROM mv WHERE seq IS NOT NULL"""))
def _c23(spark, sf):
    return fg.evidence_log(fg.match_verdicts(st.verdicts(spark, sf), st.findings(spark, sf)))


@query("C10_downgrade", sql("fi sev", f"SELECT seq, {_DOWN.format(r='rnk', s='fi.severity', n='1')} AS severity FROM fi JOIN sev USING (severity)"))
def _c10(spark, sf):
    return st.findings(spark, sf).select("seq", sev.downgrade(F.col("severity")).alias("severity"))


@query("C9_bump", sql("fi sev", f"SELECT seq, ({_LADDER})[CAST(least(rnk + k % 3, 4) + 1 AS INT)] AS severity FROM fi JOIN sev USING (severity)"))
def _c9(spark, sf):
    return st.findings(spark, sf).select("seq", sev.bump(F.col("severity"), F.col("k") % 3).alias("severity"))


_NARR = """
  WITH n AS (SELECT run_id, count(*) AS size FROM fi GROUP BY 1)
  SELECT na.run_id, na.ord, f.rule_id, CASE WHEN f.seq IS NULL THEN 'unknown_finding' END AS error,
    CASE WHEN f.seq IS NULL THEN 'no finding at position ' || finding_idx || ' of a run of ' || size END AS detail
  FROM na LEFT JOIN fi f ON f.run_id = na.run_id AND f.seq = na.finding_idx LEFT JOIN n ON n.run_id = na.run_id
"""


@query("J11_attach_narratives", sql("na fi", _NARR))
def _j11(spark, sf):
    return fg.attach_narratives(st.narratives(spark, sf), st.findings(spark, sf)).select("run_id", "ord", "rule_id", "error", "detail")


# --- J8, J9, A20-A22, K8: evaluation --------------------------------------------------------------

def _eval_inputs(spark, sf):
    f = st.findings(spark, sf)
    fixtures = f.groupBy("file").agg(F.min(F.col("uid") % 50).alias("n")).select(
        "file", F.element_at(F.array(*[F.lit(c) for c in ("leakage", "secrets", "supply_chain", "deserialization", "adversarial")]),
                             (F.col("n") % 5 + 1).cast("int")).alias("check"))
    return fixtures, f.filter("et <> 'click' AND uid % 50 NOT IN (3, 17)").select("file", "rule_id"), f.filter("et <> 'view'").select("file", "rule_id")


_EVAL = """
  fx AS (SELECT file, (['leakage', 'secrets', 'supply_chain', 'deserialization', 'adversarial'])[CAST(min(uid % 50) % 5 + 1 AS INT)] AS "check" FROM fi GROUP BY 1),
  e AS (SELECT file, rule_id, count(*) AS n FROM fi WHERE et <> 'click' AND uid % 50 NOT IN (3, 17) GROUP BY 1, 2),
  a AS (SELECT file, rule_id, count(*) AS n FROM fi WHERE et <> 'view' GROUP BY 1, 2),
  m AS (SELECT file, rule_id, least(coalesce(e.n, 0), coalesce(a.n, 0)) AS tp, greatest(coalesce(a.n, 0) - coalesce(e.n, 0), 0) AS fp,
               greatest(coalesce(e.n, 0) - coalesce(a.n, 0), 0) AS fn FROM e FULL JOIN a USING (file, rule_id)),
  s AS (SELECT "check", CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn
        FROM fx LEFT JOIN m USING (file) GROUP BY 1),
  sc AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 1) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 1) AS r FROM s)
"""


@query("J8_multiset_score", sql("fi", f"WITH {_EVAL} SELECT * FROM m"))
def _j8(spark, sf):
    _, expected, actual = _eval_inputs(spark, sf)
    return ev.multiset_score(expected, actual)


@query("A20_check_scores", sql("fi", f"""WITH {_EVAL} SELECT "check", tp, fp, fn, round(p, 6) AS "precision", round(r, 6) AS recall,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM sc"""))
def _a20(spark, sf):
    return ev.check_scores(*_eval_inputs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("A21_overall_recall", sql("fi", f"WITH {_EVAL} SELECT round(sum(tp) / (sum(tp) + sum(fn))::DOUBLE, 6) AS overall_recall FROM sc"))
def _a21(spark, sf):
    return ev.overall_recall(ev.check_scores(*_eval_inputs(spark, sf))).withColumn("overall_recall", F.round("overall_recall", 6))


@query("A22_recall_gate", sql("fi", f'WITH {_EVAL} SELECT "check" FROM sc WHERE r < 0.91'))
def _a22(spark, sf):
    return ev.below_floor(ev.check_scores(*_eval_inputs(spark, sf)), 0.91).select("check")


@query("J9_missing_baseline", sql("fi", f"WITH {_EVAL} SELECT file, \"check\" FROM fx WHERE file NOT IN (SELECT file FROM e)"))
def _j9(spark, sf):
    fixtures, expected, _ = _eval_inputs(spark, sf)
    return ev.missing_baseline(fixtures, expected)


@query("K8_regenerate_baseline", sql("fi", f"""
  WITH {_EVAL} SELECT file, rule_id, count(rule_id) AS n FROM fx LEFT JOIN (SELECT file, rule_id FROM fi) USING (file) GROUP BY 1, 2"""))
def _k8(spark, sf):
    f = st.findings(spark, sf)
    fixtures, _, _ = _eval_inputs(spark, sf)
    return ev.regenerate_baseline(fixtures, f)


# --- K1, H1-H5, J1, J2, T4: history ---------------------------------------------------------------

_RUNS = """
  r AS (SELECT rr.run_id, target, started_at, finished_at, count(fi.seq) AS total_findings, arg_max(fi.severity, rnk) AS max_severity,
               coalesce(max(rnk) >= 3, false) AS blocking FROM rr LEFT JOIN fi USING (run_id) LEFT JOIN sev ON sev.severity = fi.severity GROUP BY 1, 2, 3, 4)
"""
_PK = """
  p AS (SELECT *, row_number() OVER (ORDER BY run_id, pos, seq) AS finding_pk FROM fi JOIN checks USING ("check"))
"""


def _history(spark, sf):
    root = st.scratch(spark, "history")
    hs.record_runs(root, st.findings(spark, sf), st.run_rows(spark, sf), st.check_runs(spark, sf))
    return hs.read_history(spark, root)


@query("K1_record_findings", sql("fi checks", f"WITH {_PK} SELECT finding_pk, run_id, rule_id, \"check\" AS check_name, severity, file, line_start FROM p"))
def _k1(spark, sf):
    return _history(spark, sf)["findings"].select("finding_pk", "run_id", "rule_id", "check_name", "severity", "file", "line_start")


@query("K1_retried_write", sql("fi rr", """
  SELECT run_id, count(seq) AS findings, count(DISTINCT seq) AS keys FROM rr LEFT JOIN fi USING (run_id) GROUP BY 1"""))
def _k1r(spark, sf):
    """Half of the runs written first, then all of them twice: each counts once, with keys of its own."""
    root, found, runs, checks = st.scratch(spark, "history"), st.findings(spark, sf), st.run_rows(spark, sf), st.check_runs(spark, sf)
    half = F.crc32("run_id") % 2 == 0
    hs.record_runs(root, found.filter(half), runs.filter(half), checks.filter(half))
    for _ in range(2):
        hs.record_runs(root, found, runs, checks)
    h = hs.read_history(spark, root)
    return h["runs"].join(h["findings"], "run_id", "left").groupBy("run_id").agg(F.count("finding_pk").alias("findings"), F.countDistinct("finding_pk").alias("keys"))


@query("K1_record_checks", sql("cr fi", 'SELECT run_id, "check" AS check_name, duration_ms, tool_status, count(seq) AS findings_count FROM cr LEFT JOIN fi USING (run_id, "check") GROUP BY 1, 2, 3, 4'))
def _k1c(spark, sf):
    return hs.build_check_results(st.findings(spark, sf), st.check_runs(spark, sf))


@query("K1_record_fixes", sql("fi checks", f"""WITH {_PK} SELECT run_id, finding_pk, fix_summary AS summary, fix_confidence AS confidence, fix_replacement AS replacement,
  'deterministic' AS author FROM p WHERE has_fix"""))
def _k1f(spark, sf):
    return _history(spark, sf)["fix_proposals"].drop("diff")


@query("H1_list_runs", sql("rr fi sev", f"WITH {_RUNS} SELECT * FROM r ORDER BY started_at DESC, run_id LIMIT 20"))
def _h1(spark, sf):
    return hs.list_runs(hs.build_runs(st.findings(spark, sf), st.run_rows(spark, sf))).drop("invocation", "extra")


@query("T4_newest_runs", sql("rr fi sev", f"WITH {_RUNS} SELECT run_id, started_at FROM r ORDER BY started_at DESC, run_id LIMIT 3"))
def _t4(spark, sf):
    return hs.list_runs(hs.build_runs(st.findings(spark, sf), st.run_rows(spark, sf)), 3).select("run_id", "started_at")


@query("H2_get_run", sql("rr fi sev", f"WITH {_RUNS} SELECT * FROM r WHERE run_id = 'run-4'"))
def _h2(spark, sf):
    return hs.get_run(hs.build_runs(st.findings(spark, sf), st.run_rows(spark, sf)), "run-4").drop("invocation", "extra")


_H3 = "finding_pk, rule_id, severity, file, line_start, CASE WHEN has_fix THEN fix_summary END AS fix_summary, CASE WHEN has_fix THEN fix_confidence END AS fix_confidence, fix_replacement"


@query("H3_findings_for_run", sql("fi checks", f"WITH {_PK} SELECT {_H3} FROM p WHERE run_id = 'run-2' ORDER BY finding_pk"))
def _h3(spark, sf):
    h = _history(spark, sf)
    return hs.findings_for_run(h["findings"], h["fix_proposals"], "run-2").select(
        "finding_pk", "rule_id", "severity", "file", "line_start", "fix_summary", "fix_confidence", "fix_replacement")


@query("J1_finding_fix_join", sql("fi checks", f"WITH {_PK} SELECT {_H3} FROM p"))
def _j1(spark, sf):
    numbered = hs.number_findings(st.findings(spark, sf))
    fixes = hs.build_fixes(numbered).select("finding_pk", *[F.col(c).alias(f"fix_{c}") for c in ("summary", "confidence", "replacement")])
    return hs.build_findings(numbered).join(fixes, "finding_pk", "left").select(
        "finding_pk", "rule_id", "severity", "file", "line_start", "fix_summary", "fix_confidence", "fix_replacement")


_H4 = "SELECT run_id, target, started_at, severity, file, line_start FROM fi JOIN rr USING (run_id) WHERE rule_id = 'secrets.slack-token'"


@query("H4_runs_by_rule", sql("fi rr", _H4))
def _h4(spark, sf):
    h = _history(spark, sf)
    return hs.runs_by_rule(h["findings"], h["runs"], "secrets.slack-token", h["rule_runs"])


@query("J2_findings_join_runs", sql("fi rr", _H4))
def _j2(spark, sf):
    f = st.findings(spark, sf)
    return hs.runs_by_rule(f, hs.build_runs(f, st.run_rows(spark, sf)), "secrets.slack-token")


@query("H5_show_run", sql("rr fi sev", f"""WITH {_RUNS}, m AS (SELECT * FROM (SELECT * FROM r ORDER BY started_at DESC, run_id LIMIT 200) WHERE starts_with(run_id, 'run-1'))
  SELECT run_id, target, total_findings, count(*) OVER () AS matches FROM m"""))
def _h5(spark, sf):
    return hs.show_run(hs.build_runs(st.findings(spark, sf), st.run_rows(spark, sf)), "run-1").select("run_id", "target", "total_findings", "matches")


# --- K6, K7, X4, C11, C12, C14, C15: export -------------------------------------------------------

_PASCAL = "array_to_string(list_transform(list_filter(regexp_split_to_array({c}, '[-.]'), lambda p: p <> ''), lambda p: upper(p[1:1]) || lower(p[2:])), '')"
_LEVEL = "CASE {s} WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"
_SCORE = "CASE {s} WHEN 'critical' THEN '9.5' WHEN 'high' THEN '7.5' WHEN 'medium' THEN '5.5' WHEN 'low' THEN '3.5' ELSE '2.0' END"


@query("K7_rule_descriptors", sql("fi", f"""
  SELECT rule_id, {_PASCAL.format(c='rule_id')} AS name, category, {_LEVEL.format(s='severity')} AS level, {_SCORE.format(s='severity')} AS security_severity, "check"
  FROM (SELECT rule_id, arg_min(category, (run_id, seq)) AS category, arg_min(severity, (run_id, seq)) AS severity, arg_min("check", (run_id, seq)) AS "check" FROM fi GROUP BY 1)"""))
def _k7(spark, sf):
    return ex.rule_descriptors(st.findings(spark, sf))


@query("X4_distinct_rules", sql("fi", "SELECT DISTINCT run_id, rule_id FROM fi"))
def _x4(spark, sf):
    return ex.rule_descriptors(st.findings(spark, sf), ("run_id",)).select("run_id", "rule_id")


@query("K6_sarif_results", sql("fi", f"""
  SELECT run_id, seq, rule_id, {_LEVEL.format(s='severity')} AS level, message AS text, file AS uri, CAST(line_start AS VARCHAR) AS start_line, CAST(line_end AS VARCHAR) AS end_line,
    evidence AS snippet, {_SCORE.format(s='severity')} AS score, CASE WHEN has_fix THEN fix_summary END AS fix_text, fix_replacement AS inserted FROM fi"""))
def _k6(spark, sf):
    at = lambda path: F.get_json_object("j", path)
    physical = "$.locations[0].physicalLocation"
    return st.findings(spark, sf).select("run_id", "seq", ex.result_json("/src").alias("j")).select(
        "run_id", "seq", at("$.ruleId").alias("rule_id"), at("$.level").alias("level"), at("$.message.text").alias("text"),
        at(physical + ".artifactLocation.uri").alias("uri"), at(physical + ".region.startLine").alias("start_line"),
        at(physical + ".region.endLine").alias("end_line"), at(physical + ".region.snippet.text").alias("snippet"),
        at("$.properties.security-severity").alias("score"), at("$.properties.fixDescription").alias("fix_text"),
        at("$.fixes[0].artifactChanges[0].replacements[0].insertedContent.text").alias("inserted"))


@query("K6_sarif_lines", sql("fi cr", """
  WITH l AS (SELECT DISTINCT run_id, 0 AS part FROM cr UNION ALL SELECT DISTINCT run_id, 2 FROM cr UNION ALL SELECT DISTINCT run_id, 4 FROM cr
    UNION ALL SELECT run_id, 1 FROM (SELECT DISTINCT run_id, rule_id FROM fi) UNION ALL SELECT run_id, 3 FROM fi)
  SELECT run_id, part, count(*) AS lines FROM l GROUP BY 1, 2"""))
def _k6l(spark, sf):
    return ex.sarif_lines(st.findings(spark, sf), st.check_runs(spark, sf)).groupBy("run_id", "part").agg(F.count("*").alias("lines"))


@query("C11_report_level", sql("fi", f"SELECT seq, {_LEVEL.format(s='severity')} AS level, {_SCORE.format(s='severity')} AS score FROM fi"))
def _c11(spark, sf):
    return st.findings(spark, sf).select("seq", sev.report_level(F.col("severity")).alias("level"), sev.security_score(F.col("severity")).alias("score"))


@query("C12_pascal_case", sql("fi", f"SELECT seq, {_PASCAL.format(c='rule_id')} AS name FROM fi"))
def _c12(spark, sf):
    return st.findings(spark, sf).select("seq", tx.pascal_case(F.col("rule_id")).alias("name"))


@query("C14_relative_path", sql("fxp", "SELECT path, CASE WHEN starts_with(path, '/data/fx/leakage/') THEN substr(path, 18) ELSE path END AS uri FROM fxp"))
def _c14(spark, sf):
    return st.order_paths(spark, sf, "fixture").select("path", tx.relative_path(F.col("path"), "/data/fx/leakage").alias("uri"))


@query("C15_truncations", "SELECT doc_id, length(left(text, 200)) AS short, md5(left(text, 400)) AS snippet FROM documents")
def _c15(spark, sf):
    return st.table(spark, sf, "documents").select(
        "doc_id", F.length(F.substring("text", 1, 200)).cast("bigint").alias("short"), F.md5(F.substring("text", 1, 400).cast("binary")).alias("snippet"))
