"""Rules declared as data: what patterns match, what is refused, and that the shipped rules are rows only."""

import json

import pytest

from wardflow.operators import pattern_rules as pr
from wardflow.operators import rules as rl
from wardflow.plans import audit as au

from .conftest import notebook


def rule(*clauses, id="own.rule", message="", **more):
    return {"id": id, "severity": "ERROR", "message": message, "patterns": [{"pattern": c} if isinstance(c, str) else c for c in clauses], **more}


def found(spark, source, *rules, kind="python"):
    compiled, problems = pr.parse_rules({"rules": list(rules)})
    assert problems == []
    files = spark.createDataFrame([("a.py" if kind == "python" else "a.ipynb", source, kind)], "path string, content string, source_kind string")
    rows = rl.declared_findings(files, compiled).select("rule_id", "line_start", "message").collect()
    return sorted((r["line_start"], r["message"]) for r in rows) if len(rules) == 1 else sorted(map(tuple, rows))


def lines_of(spark, source, wanted):
    """Lines that each pattern finds, all patterns as rules of one run."""
    rows = found(spark, source, *[rule(p, id=f"own.{k}") for k, p in enumerate(wanted)], rule("never()"))
    return {p: [n for i, n, _ in rows if i == f"own.{k}"] for k, p in enumerate(wanted)}


ARGUMENTS = {
    "f()": [1], "f(...)": [1, 2, 3, 4, 5, 6, 7, 8], "f($X)": [2], "f($X, ...)": [2, 3, 4, 8], "f(..., b)": [3, 8], "f(..., b, ...)": [3, 4, 8],
    "f(a, ..., c)": [4], "f(..., b, ..., c, ...)": [4], "f($X, $X)": [8], "f(k=1)": [5], "f(..., k=1)": [5, 6], "f(..., k=..., ...)": [5, 6],
    "f(..., k=$V, j=2, ...)": [6], "f(a, b)": [3], "f(..., 'x', ...)": [], "f(j=2, k=1)": [6], "f(..., a, ..., $X, ...)": [3, 4], "f(..., $X, ..., $X, ...)": [8],
}
CALLEES = {
    "torch.load($F)": [4, 5, 6], "load($F)": [4, 7], "$M.load($F)": [5, 6, 8], "$F(...)": [4, 7], "$O.$M(...)": [5, 6, 8, 9], "$A.inner.run()": [9],
    "a.b.inner.run()": [9], "a.$M()": [], "json.$M($X)": [8],
}


def test_arguments(spark):
    source = "f()\nf(a)\nf(a, b)\nf(a, b, c)\nf(k = 1)\nf(j=2, k=1)\nf(*a)\nf(b, b)\n"
    assert lines_of(spark, source, ARGUMENTS) == ARGUMENTS


def test_callees(spark):
    source = "import torch\nimport torch as t\nfrom torch import load as ld\nld('x')\ntorch.load(\"y\")\nt.load(z)\nload(1)\njson.load(2)\na.b.inner.run()\n"
    assert lines_of(spark, source, CALLEES) == CALLEES


def test_clauses_bind_and_speak(spark):
    source = "s.fit(X_test)\ns.fit(train)\nt.fit(X_test, s)\ns.go(s)\n"
    own = rule("$O.fit($X, ...)", {"metavariable-regex": {"metavariable": "$X", "regex": "X_"}}, {"pattern-not": "$O.fit($X, $O)"}, message="$O fits $X, not $Y")
    assert found(spark, source, own) == [(1, "s fits X_test, not $Y"), (3, "t fits X_test, not $Y")]
    assert found(spark, source, rule("$O.$M(..., $O, ...)", message="$M")) == [(4, "go")]
    either = rule({"pattern-either": ["$O.go($X)", {"pattern": "$O.fit($X)"}]}, message="$X")
    assert found(spark, source, either) == [(1, "X_test"), (2, "train"), (4, "s")]
    middle = rule("f(..., $X, ...)", {"metavariable-regex": {"metavariable": "$X", "regex": "test"}}, message="$X")
    assert found(spark, "f(a, test_b, test_c)\nf(a)\n", middle) == [(1, "test_b")]
    assert found(spark, "f('q')\nf(\"q\")\nf(q)\n", rule("f('q')")) == [(1, ""), (2, "")]


def test_kinds_and_cells(spark):
    text = notebook("x = 1", "s.fit(X_test)")
    own = rule("$O.fit($X)", message="$X", kinds=["notebook"])
    assert found(spark, text, own, kind="notebook") == [(1, "[cell 1] X_test")] and found(spark, "s.fit(a)", own) == []
    assert found(spark, text, rule("$O.fit($X)"), kind="notebook") == []


@pytest.mark.parametrize("bad, problem", [
    ("text", "object"), ({"id": "a"}, "message"), (rule("f()", severity="LOUD"), "severity"), (rule("f()", languages=["java"]), "python"),
    (rule(), "needs a pattern"), (rule("f("), "not a pattern"), (rule("x + 1"), "only calls"), (rule("f(g($X))"), "whole arguments"), (rule("g()(1)"), "dotted name"),
    (rule("f(*xs)"), "starred"), (rule({"pattern-inside": "f()"}), "unknown clause"), (rule("f($X)", {"metavariable-regex": {"metavariable": "$Y", "regex": "a"}}), "not in every"),
    (rule("f($X)", {"metavariable-regex": {"metavariable": "$X", "regex": "("}}), "bad expression"), (rule("f()", kinds=["java"]), "kinds"), (rule("a.$B.c()"), "middle"),
    (rule({"pattern-either": []}), "list"), (rule({"pattern": 5}), "text"),
])
def test_malformed_rules_are_reported(bad, problem):
    rules, problems = pr.parse_rules({"rules": [bad, rule("f()", id="own.good")]})
    assert [r.id for r in rules] == ["own.good"] and len(problems) == 1 and problem in problems[0][1]


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rules": [rule("f()", id="own.a"), rule("f()", id="own.a")]}))
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text(json.dumps({"rules": [rule("g()", id="own.a"), rule("g()", id="own.c")]}))
    (tmp_path / "d.json").write_text("[]")
    rules, problems = pr.read_rules(spark, str(tmp_path))
    assert [r.id for r in rules] == ["own.a", "own.c"]
    got = {(r["file"].rsplit("/")[-1], r["id"]) for r in problems.collect()}
    assert got == {("a.json", "own.a"), ("b.json", ""), ("c.json", "own.a"), ("d.json", "")}


def test_shipped_rules_are_data(spark):
    files = spark.createDataFrame([("a.py", "s.fit(X_test)\ns.fit_transform(test_X, y)\ntrain_test_split(X, shuffle=False)\ns.fit(x_test)\n")], "path string, content string")
    ids = lambda declared: sorted(r["rule_id"] for r in au.audit_findings(files, "r", declared=declared).collect() if r["rule_id"].startswith("ml-"))
    assert ids(rl.SHIPPED) == sorted(r.id for r in rl.SHIPPED) and ids(()) == []
    extra = pr.parse_rules({"rules": [rule("$S.fit($X)", id="ml-own", metadata={"category": "style", "fix": "Do not."})]})[0]
    (first, second) = [r for r in au.audit_findings(files, "r", declared=extra).collect() if r["rule_id"] == "ml-own"]
    assert (first["category"], first["severity"], first["fix"]["summary"], {first["line_start"], second["line_start"]}) == ("style", "high", "Do not.", {1, 4})
