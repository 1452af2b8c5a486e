"""Atomic run history: killed writes, retries, two writers, keys, odd run ids and the index by rule."""

import pytest
from pyspark.sql import functions as F

from wardflow import commits
from wardflow.operators import history as hs

FINDING = ("run_id string, seq bigint, rule_id string, `check` string, severity string, category string, file string, line_start int, line_end int, "
           "message string, evidence string, fix struct<summary: string, diff: string, replacement: string, confidence: string>")


def inputs(spark, *run_ids, rule="r.a", n=3):
    rows = [(run, k, rule if k else "r.first", "leakage", "high", "c", f"f{k}", k, k, "m", "e", ("s", None, None, "low") if k else None) for run in run_ids for k in range(n)]
    runs = spark.createDataFrame([(r,) for r in run_ids], "run_id string").select(
        "run_id", F.lit("t").alias("target"), F.lit("2024-01-01").cast("timestamp").alias("started_at"), F.lit("2024-01-01").cast("timestamp").alias("finished_at"),
        F.lit("cli").alias("invocation"), F.create_map(F.lit("a"), F.lit("b")).alias("extra"))
    checks = spark.createDataFrame([(r, "leakage", 5, "ok") for r in run_ids], "run_id string, `check` string, duration_ms bigint, tool_status string")
    return spark.createDataFrame(rows, FINDING), runs, checks


def seen(spark, root):
    h = hs.read_history(spark, root)
    keys = [r["finding_pk"] for r in h["findings"].collect()]
    assert len(keys) == len(set(keys))
    fixes = sorted(r["finding_pk"] for r in h["fix_proposals"].collect())
    assert set(fixes) <= set(keys)
    runs = {r["run_id"]: r["total_findings"] for r in h["runs"].collect()}
    assert sorted(r["run_id"] for r in h["check_results"].collect()) == sorted(runs)
    counts = {r["run_id"]: r["count"] for r in h["findings"].groupBy("run_id").count().collect()}
    assert {k: v for k, v in runs.items() if v} == counts
    return runs


def test_retry_adds_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert seen(spark, root) == {}
    assert hs.record_runs(root, *inputs(spark, "a", "b")) == ["a", "b"] and hs.record_runs(root, *inputs(spark, "a", "b")) == []
    assert hs.record_runs(root, *inputs(spark, "b", "c")) == ["c"] and seen(spark, root) == {"a": 3, "b": 3, "c": 3}


@pytest.mark.parametrize("after", [0, 1])
def test_killed_write(spark, tmp_path, monkeypatch, after):
    """Killed before any commit, and between the commits of two runs: what is not committed does not show."""
    root, real, done = str(tmp_path), commits.create_once, []

    def dies(spark, path, text):
        if "/commits/" in path:
            if len(done) == after:
                raise RuntimeError("killed")
            done.append(path)
        return real(spark, path, text)

    monkeypatch.setattr(commits, "create_once", dies)
    with pytest.raises(RuntimeError):
        hs.record_runs(root, *inputs(spark, "a", "b"))
    monkeypatch.undo()
    assert seen(spark, root) == {"a": 3} if after else seen(spark, root) == {}
    assert hs.record_runs(root, *inputs(spark, "a", "b")) == (["b"] if after else ["a", "b"]) and seen(spark, root) == {"a": 3, "b": 3}
    assert len(hs.remove_uncommitted(spark, root)) == (0 if after else 1) and seen(spark, root) == {"a": 3, "b": 3}


def test_two_writers(spark, tmp_path, monkeypatch):
    """A second writer works while the first has staged its rows: distinct keys, and the run of both counts once."""
    root, real, others = str(tmp_path), hs.build_runs, [("b", "c")]

    def meanwhile(findings, runs):
        if others:
            assert hs.record_runs(root, *inputs(spark, *others.pop(), n=5)) == ["b", "c"]
        return real(findings, runs)

    monkeypatch.setattr(hs, "build_runs", meanwhile)
    assert hs.record_runs(root, *inputs(spark, "a", "b")) == ["a"]
    assert seen(spark, root) == {"a": 3, "b": 5, "c": 5}


def test_a_claim_is_never_given_twice(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert [hs.claim_keys(spark, root, n) for n in (5, 0, 7)][::2] == [0, 5]
    real, late = commits.names, [True]

    def outdated(spark, path):  # the list a writer saw before another one claimed
        found = real(spark, path)
        return found[:-1] if late and late.pop() else found

    monkeypatch.setattr(commits, "names", outdated)
    assert hs.claim_keys(spark, root, 1) == 12


def test_odd_ids_and_runs_without_findings(spark, tmp_path):
    root, odd = str(tmp_path), ["007", "a/b c%", "é=1", "2024-01-01"]
    found, runs, checks = inputs(spark, *odd)
    assert hs.record_runs(root, found.filter("run_id <> '007'"), runs, checks) == sorted(odd)
    assert seen(spark, root) == {"007": 0, "a/b c%": 3, "é=1": 3, "2024-01-01": 3}
    h = hs.read_history(spark, root)
    assert [r["finding_pk"] for r in hs.findings_for_run(h["findings"], h["fix_proposals"], "a/b c%").collect()] == sorted(
        r["finding_pk"] for r in h["findings"].filter("run_id = 'a/b c%'").collect())


def test_rule_index(spark, tmp_path):
    """The index names the runs of a rule, and only their folders are candidates for the scan."""
    root = str(tmp_path)
    for k in range(4):
        hs.record_runs(root, *inputs(spark, f"run{k}", rule=f"rule{k % 2}"))
    h = hs.read_history(spark, root)
    assert {r["run_id"]: r["findings"] for r in h["rule_runs"].filter("rule_id = 'rule1'").collect()} == {"run1": 2, "run3": 2}
    found = hs.runs_by_rule(h["findings"], h["runs"], "rule1", h["rule_runs"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, hs.runs_by_rule(h["findings"], h["runs"], "rule1").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "run_id" in plan.split("dynamicpruning")[0][-400:] and "EqualTo(rule_id,rule1)" in plan
