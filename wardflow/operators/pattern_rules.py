"""Rules declared as data: call patterns with metavariables, compiled to expressions over call-site facts.

A pattern is a call as one would write it, with `$NAME` for any callee part or argument (the same name twice asks for
the same text) and `...` for any further arguments; `name=...` asks for a keyword of any value. A rule holds one
`pattern`, or `patterns` of which all hold: `pattern`, `pattern-either`, `pattern-not` and `metavariable-regex` (matched
from the start of the text). Keywords match in any order. Rules become parts of one projection, grouped by
the name they call, so any number of rules costs one parse and one pass.
"""

from __future__ import annotations

import ast
import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import collect_bounded

MAX_RULES = 10_000
SHIPPED = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rules", "ml-hygiene.json")
SEVERITIES = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}  # fixed values
_REST, _META = "_any_rest_", "_meta_"
_CLAUSES = ("pattern", "pattern-either", "pattern-not", "metavariable-regex")
ORIGINS = ", "  # between the names a callee may have, as in the facts


class RuleError(ValueError):
    """A rule that cannot be compiled, with the reason."""


@dataclass(frozen=True)
class CallPattern:
    """Callee parts, runs of positional arguments between `...`, and keywords; None stands for any value."""

    callee: tuple[str, ...]
    runs: tuple[tuple[str | None, ...], ...]
    keywords: tuple[tuple[str, str | None], ...]

    @property
    def open_ended(self) -> bool:
        return len(self.runs) > 1


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    message: str
    category: str = "data-leakage"
    fix: str | None = None
    kinds: tuple[str, ...] = ("python",)
    any_of: tuple[tuple[CallPattern, ...], ...] = ()
    none_of: tuple[CallPattern, ...] = ()
    regexes: tuple[tuple[str, str], ...] = field(default=())

    def callees(self) -> set[str]:
        """Last names of the calls that the rule looks at; `*` stands for every call."""
        lasts = {p.callee[-1] for group in self.any_of for p in group}
        return {"*" if name.startswith("$") else name for name in lasts}


# --- reading ------------------------------------------------------------------------------------

def normal_text(node: ast.expr) -> str:
    """Source of an expression in one normal form, so that quotes and spaces make no difference."""
    return ast.unparse(node)


def parse_pattern(text: str) -> CallPattern:
    """A call pattern; anything but a call of a dotted name is refused."""
    if not isinstance(text, str):
        raise RuleError("a pattern must be text")
    plain = re.sub(r"\$([A-Z_][A-Z0-9_]*)", rf"{_META}\1", text.strip())
    plain = re.sub(r"(?<![=\w])(\s*)\.\.\.", rf"\1*{_REST}", plain)  # as an argument; `name=...` stays
    try:
        call = ast.parse(plain, mode="eval").body
    except SyntaxError as error:
        raise RuleError(f"not a pattern: {text!r}") from error
    if not isinstance(call, ast.Call):
        raise RuleError(f"only calls can be matched: {text!r}")

    def value(node: ast.expr) -> str | None:
        if isinstance(node, ast.Constant) and node.value is Ellipsis:
            return None
        spelled = normal_text(node)
        if spelled.startswith(_META) and isinstance(node, ast.Name):
            return "$" + spelled[len(_META):]
        if _META in spelled or _REST in spelled or "..." in spelled:
            raise RuleError(f"metavariables and ... stand for whole arguments only: {text!r}")
        return spelled

    parts, at = [], call.func
    while isinstance(at, ast.Attribute):
        parts.insert(0, at.attr)
        at = at.value
    if not isinstance(at, ast.Name):
        raise RuleError(f"the callee must be a dotted name: {text!r}")
    parts = tuple("$" + p[len(_META):] if p.startswith(_META) else p for p in [at.id, *parts])
    if any(p.startswith("$") for p in parts[1:-1]):
        raise RuleError(f"a metavariable in the middle of a callee: {text!r}")
    runs: list[list[str | None]] = [[]]
    for arg in call.args:
        if isinstance(arg, ast.Starred):
            if not isinstance(arg.value, ast.Name) or arg.value.id != _REST:
                raise RuleError(f"starred arguments cannot be matched: {text!r}")
            runs.append([])
        else:
            runs[-1].append(value(arg))
    if any(k.arg is None for k in call.keywords):
        raise RuleError(f"starred arguments cannot be matched: {text!r}")
    return CallPattern(parts, tuple(map(tuple, runs)), tuple((k.arg, value(k.value)) for k in call.keywords))


def _metavariables(pattern: CallPattern) -> set[str]:
    texts = [*pattern.callee, *(v for run in pattern.runs for v in run), *(v for _, v in pattern.keywords)]
    return {t for t in texts if t is not None and t.startswith("$")}


def parse_rule(raw: object) -> Rule:
    """A rule from its document; RuleError says what is wrong with it."""
    if not isinstance(raw, dict):
        raise RuleError("a rule must be an object")
    name, message = raw.get("id"), raw.get("message")
    if not isinstance(name, str) or not name or not isinstance(message, str):
        raise RuleError("a rule needs an id and a message")
    if raw.get("severity") not in SEVERITIES:
        raise RuleError(f"unknown severity {raw.get('severity')!r}")
    if raw.get("languages", ["python"]) != ["python"]:
        raise RuleError("only python can be matched")
    kinds = raw.get("kinds", ["python"])
    if not isinstance(kinds, list) or not kinds or not set(kinds) <= {"python", "notebook"}:
        raise RuleError(f"unknown kinds {kinds!r}")
    clauses = raw.get("patterns", [{k: raw[k]} for k in ("pattern", "pattern-either") if k in raw])
    if not isinstance(clauses, list):
        raise RuleError("patterns must be a list")
    any_of, none_of, regexes = [], [], []
    for clause in clauses:
        if not isinstance(clause, dict) or len(clause) != 1 or next(iter(clause)) not in _CLAUSES:
            raise RuleError(f"unknown clause {clause!r}")
        (kind, body), = clause.items()
        if kind == "pattern":
            any_of.append((parse_pattern(body),))
        elif kind == "pattern-not":
            none_of.append(parse_pattern(body))
        elif kind == "pattern-either":
            if not isinstance(body, list) or not body:
                raise RuleError("pattern-either needs a list")
            any_of.append(tuple(parse_pattern(p["pattern"] if isinstance(p, dict) and set(p) == {"pattern"} else p) for p in body))
        else:
            if not isinstance(body, dict) or not isinstance(body.get("metavariable"), str) or not isinstance(body.get("regex"), str):
                raise RuleError(f"metavariable-regex needs a metavariable and a regex: {body!r}")
            try:
                re.compile(body["regex"])
            except re.error as error:
                raise RuleError(f"bad expression {body['regex']!r}: {error}") from error
            regexes.append((body["metavariable"], body["regex"]))
    if not any_of:
        raise RuleError("a rule needs a pattern")
    bound = set.union(*(set.intersection(*map(_metavariables, group)) for group in any_of))
    for meta, _ in regexes:
        if meta not in bound:
            raise RuleError(f"{meta} is not in every pattern")
    about = raw.get("metadata") if isinstance(raw.get("metadata"), dict) else {}
    return Rule(name, SEVERITIES[raw["severity"]], message.strip(), about.get("category") or "data-leakage", about.get("fix"),
                tuple(kinds), tuple(any_of), tuple(none_of), tuple(regexes))


def parse_rules(document: object) -> tuple[list[Rule], list[tuple[str, str]]]:
    """The rules of a document `{"rules": [...]}`, and `(id, problem)` of those that are left out."""
    listed = document.get("rules") if isinstance(document, dict) else None
    if not isinstance(listed, list):
        return [], [("", "no list of rules")]
    rules, problems, seen = [], [], set()
    for raw in listed:
        name = str(raw.get("id", "")) if isinstance(raw, dict) else ""
        try:
            rule = parse_rule(raw)
            if rule.id in seen:
                raise RuleError("the id is taken")
            seen.add(rule.id)
            rules.append(rule)
        except RuleError as error:
            problems.append((name, str(error)))
    return rules, problems


def shipped_rules() -> list[Rule]:
    with open(SHIPPED, encoding="utf-8") as text:
        rules, problems = parse_rules(json.load(text))
    if problems:
        raise RuleError(str(problems))
    return rules


def read_rules(spark: SparkSession, path: str) -> tuple[list[Rule], DataFrame]:
    """Rules of all JSON documents below a path, and a table `(file, id, problem)` of what could not be compiled.

    Rules are parameters of a job, so they are collected, up to MAX_RULES documents.
    """
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rules: list[Rule] = []
    problems: list[tuple[str, str, str]] = []
    for row in sorted(collect_bounded(texts, MAX_RULES, "rule documents"), key=lambda r: r["file"]):
        try:
            found, bad = parse_rules(json.loads(row["value"]))
        except ValueError as error:
            found, bad = [], [("", f"not JSON: {error}")]
        known = {r.id for r in rules}
        rules += [r for r in found if r.id not in known]
        problems += [(row["file"], *b) for b in bad] + [(row["file"], r.id, "the id is taken") for r in found if r.id in known]
    return rules, spark.createDataFrame(problems, "file string, id string, problem string")


# --- matching -----------------------------------------------------------------------------------

Bound = dict[str, Column]


def _bind(bound: Bound, wanted: str | None, text: Column) -> tuple[Column, Bound]:
    """Whether a text is what a pattern asks for at its place, and the metavariables after it."""
    if wanted is None:
        return text.isNotNull(), bound
    if not wanted.startswith("$"):
        return text == wanted, bound
    if wanted in bound:
        return text == bound[wanted], bound
    return text.isNotNull(), bound | {wanted: text}


def _callee(parts: tuple[str, ...], f: Column, bound: Bound) -> tuple[Column, Bound]:
    *owner, last = parts
    names = F.split(F.coalesce(f["qualified_name"], F.lit("")), ORIGINS)  # what imports make of the callee
    if not owner:
        if last.startswith("$"):
            return _bind(bound, last, f["bare_name"])
        imported = F.exists(names, lambda n: n.endswith("." + last))
        return f["object"].isNull() & ((f["bare_name"] == last) | imported), bound
    known, bound = _bind(bound, last, f["attr"])
    if owner[0].startswith("$"):
        tail = "".join("." + p for p in owner[1:])
        if tail:
            start = F.when(f["object"].endswith(tail), F.substring(f["object"], F.lit(1), F.length(f["object"]) - len(tail)))
        else:
            start = f["object"]
        fits, bound = _bind(bound, owner[0], start)
        return known & fits, bound
    if last.startswith("$"):
        return known & (f["object"] == ".".join(owner)), bound
    return (known & (f["object"] == ".".join(owner))) | F.array_contains(names, ".".join(parts)), bound


def _run_at(run: tuple[str | None, ...], args: Column, at: Column, bound: Bound) -> tuple[Column, Bound]:
    """Whether the arguments from a place (counted from 0) on are those of the run."""
    fits = F.lit(True)
    for k, wanted in enumerate(run):
        text = F.get(args, at + k)
        one, bound = _bind(bound, wanted, text)
        fits = fits & one
    return fits, bound


def _runs(runs: tuple[tuple[str | None, ...], ...], args: Column, lo: Column, bound: Bound, rest) -> tuple[Column, Bound]:
    """The runs after a `...`, each at its first place that lets the remaining ones and `rest` hold."""
    run, later = runs[0], runs[1:]
    if not later:  # the last run ends the arguments
        at = F.size(args) - len(run)
        fits, bound = _run_at(run, args, at, bound)
        more, bound = rest(bound)
        return (at >= lo) & fits & more, bound
    if not run:
        return _runs(later, args, lo, bound, rest)

    def holds(at: Column) -> Column:
        fits, inside = _run_at(run, args, at, bound)
        return fits & _runs(later, args, at + len(run), inside, rest)[0]

    places = F.filter(F.sequence(lo, F.greatest(lo, F.size(args) - len(run))), holds)
    place = F.try_element_at(places, F.lit(1))
    inside = _run_at(run, args, place, bound)[1]
    return place.isNotNull(), _runs(later, args, place + len(run), inside, rest)[1]


def _is_named(name: str):
    return lambda arg: arg["name"] == name


def match(pattern: CallPattern, f: Column, bound: Bound, rest=lambda b: (F.lit(True), b)) -> tuple[Column, Bound]:
    """Whether a fact is a call of the pattern (never null), and the texts of its metavariables.

    `rest` is what must hold besides, given the metavariables.
    """
    fits, bound = _callee(pattern.callee, f, bound)
    named = F.filter(f["args"], lambda a: a["name"].isNotNull() & ~a["name"].isin("*", "**"))
    for name, wanted in pattern.keywords:
        text = F.get(F.filter(named, _is_named(name)), F.lit(0))["text"]
        one, bound = _bind(bound, wanted, text)
        fits = fits & one
    # A starred argument has a place but no text, so only `...` goes over it.
    args = F.transform(F.filter(f["args"], lambda a: a["name"].isNull() | (a["name"] == "*")), lambda a: F.when(a["name"].isNull(), a["text"]))
    first, *later = pattern.runs
    at_start, bound = _run_at(first, args, F.lit(0), bound)
    if later:
        more, bound = _runs(tuple(later), args, F.lit(len(first)), bound, rest)
        within = F.size(args) >= len(first)
    else:
        more, bound = rest(bound)
        spread = F.exists(f["args"], lambda a: a["name"].isin("*", "**"))
        within = (F.size(args) == len(first)) & (F.size(named) == len(pattern.keywords)) & ~F.coalesce(spread, F.lit(False))
    return F.coalesce(fits & within & at_start & more, F.lit(False)), bound


def _message(template: str, bound: Bound) -> Column:
    parts = re.split(r"(\$[A-Z_][A-Z0-9_]*)", template)
    return F.concat(*[bound[p] if p in bound else F.lit(p) for p in parts if p])


def rule_match(rule: Rule, f: Column) -> tuple[Column, Column]:
    """Whether a fact breaks the rule, and the rule's message with the texts it found."""

    def besides(bound: Bound) -> tuple[Column, Bound]:
        fits = F.lit(True)
        for meta, regex in rule.regexes:
            if meta in bound:
                fits = fits & bound[meta].rlike(f"^(?:{regex})")
        return F.coalesce(fits, F.lit(False)), bound

    def all_of(groups, bound: Bound) -> tuple[Column, Column]:
        """Condition and message of the first way to meet one pattern of each group."""
        if not groups:
            cond = besides(bound)[0]
            for unwanted in rule.none_of:
                cond = cond & ~match(unwanted, f, bound)[0]
            return cond, _message(rule.message, bound)
        cond, text = F.lit(False), F.lit(None).cast("string")
        for pattern in reversed(groups[0]):
            fits, inside = match(pattern, f, bound, besides)
            more, message = all_of(groups[1:], inside)
            text = F.when(fits & more, message).otherwise(text)
            cond = (fits & more) | cond
        return cond, text

    return all_of(rule.any_of, {})


def declared_hits(rules: Iterable[Rule], f: Column, kind: Column, make) -> Column:
    """Array of hits of one fact, in the order of the rules; `make(rule, condition, message)` is a hit or null."""
    listed = []
    for rule in rules:
        cond, message = rule_match(rule, f)
        name = F.coalesce(f["attr"], f["bare_name"])
        cheap = kind.isin(*rule.kinds)
        if "*" not in rule.callees() and all(len(p.callee) > 1 and p.callee[0].startswith("$") for g in rule.any_of for p in g):
            cheap = cheap & name.isin(*sorted(rule.callees()))  # methods keep their name, whatever is imported
        listed.append(make(rule, F.when(cheap, cond).otherwise(False), message))
    return F.array_compact(F.array(*listed)) if listed else None


def wanted_calls(rules: Iterable[Rule]) -> frozenset[str]:
    return frozenset().union(*(r.callees() for r in rules))
