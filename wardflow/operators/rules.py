"""Corpus rules: text lines and call-site facts in, finding rows out.

All rules of a family come out of one pass over the files: each row carries its own context (the
earliest split line, the dropped columns, whether a digest is checked anywhere), so no rule needs
a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import RULES, SECRET_PATTERNS, lookup
from ..functions import severity as sev
from ..functions import text as tx
from ..sources import notebooks as nb
from ..sources.requirements import names_requirement, requirement_lines
from ..sources.tool_json import read_advisories, read_pattern_results
from . import callsites as cs
from . import pattern_rules as pr

_CHECK = {r[0]: r[1] for r in RULES}
_SEVERITY = {r[0]: r[2] for r in RULES}
_CATEGORY = {r[0]: r[3] for r in RULES}
_FIX = {r[0]: r[5] for r in RULES}
_CONFIDENCE = {r[0]: r[4] for r in RULES}
REVIEW_HINT = "A rule of an external scanner fired; read the code at this place."
NO_FIX = "a patched release"


def fix_struct(summary: Column, confidence: Column, replacement: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        summary.alias("summary"), text.alias("diff"),
        (text if replacement is None else replacement).alias("replacement"), confidence.alias("confidence"),
    )


SHIPPED = tuple(pr.shipped_rules())  # the rules of the library that are data


def as_findings(
    hits: DataFrame, file: str = "path", fix_summary: Column | None = None, severity: Column | None = None,
    declared: Sequence[pr.Rule] = SHIPPED,
) -> DataFrame:
    """Complete `(rule_id, line_start, line_end, message, evidence)` rows from the rule table and the declared rules."""
    rule = F.col("rule_id")
    severities, categories = _SEVERITY | {r.id: r.severity for r in declared}, _CATEGORY | {r.id: r.category for r in declared}
    fixes = _FIX | {r.id: r.fix for r in declared if r.fix}
    return hits.select(
        "rule_id", lookup(_CHECK, rule, "leakage").alias("check"),
        (lookup(severities, rule) if severity is None else severity).alias("severity"),
        lookup(categories, rule, "data-leakage").alias("category"), F.col(file).alias("file"),
        F.col("line_start").cast("int"), F.col("line_end").cast("int"), "message", "evidence",
        fix_struct(
            lookup(fixes, rule, REVIEW_HINT) if fix_summary is None else fix_summary, lookup(_CONFIDENCE, rule, "medium")
        ).alias("fix"),
    )


# A hit is what a rule says about one place; as_findings completes it from the rule table.
def hit(
    rule_id: Column | str, line_start: Column, line_end: Column, message: Column, evidence: Column, order: int = 0
) -> Column:
    rule_id = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    return F.struct(
        rule_id.alias("rule_id"), F.lit(order).alias("source_order"), line_start.cast("int").alias("line_start"),
        line_end.cast("int").alias("line_end"), message.alias("message"), evidence.alias("evidence"),
    )


NO_HITS = "cast(array() AS array<struct<rule_id: string, source_order: int, line_start: int, line_end: int, " \
          "message: string, evidence: string>>)"
_MARGIN = r"^\s+|\s+$"


# --- supply chain -------------------------------------------------------------------------------

MAYBE_INSTALL = r"[!%]pip|wget|curl"


def install_line_hits(line: Column, line_no: Column, cell_idx: Column, verified: Column) -> Column:
    """Unpinned installs and unverified downloads on one line of a code cell."""
    cell, evidence = cell_idx.cast("string"), F.regexp_replace(line, _MARGIN, "")
    specs = F.filter(tx.package_specs(F.regexp_extract(line, tx.PIP_LINE, 1)), lambda s: ~tx.is_pinned(s))
    installs = F.transform(specs, lambda s: hit(
        "supply_chain.unpinned-pip-install", line_no, line_no,
        F.concat(F.lit("`"), s, F.lit("` is installed without a version (cell "), cell, F.lit(")")), evidence,
    ))
    tool = F.regexp_extract(line, tx.DOWNLOAD_LINE, 1)
    download = F.array(hit(
        "supply_chain.untrusted-wget-source", line_no, line_no,
        F.concat(F.lit("`"), tool, F.lit("` downloads a file that no cell verifies (cell "), cell, F.lit(")")), evidence,
    ))
    return F.when(line.rlike(tx.PIP_LINE), installs).when(
        line.rlike(tx.DOWNLOAD_LINE) & ~verified, download
    ).otherwise(F.expr(NO_HITS))


def verifies_downloads(code: Column) -> Column:
    """Any mention of a digest anywhere in the notebook's code."""
    return F.exists(code, lambda c: tx.has_checksum_hint(c["source"]))


def install_lines(notebooks: DataFrame) -> DataFrame:
    """Shell lines of code cells that install packages or download files, one row per line."""
    cells = notebooks.select("path", nb.code_cells("content").alias("code")).select("path", verifies_downloads(F.col("code")).alias("verified"), F.explode_outer("code").alias("c"))
    rows = cells.filter(F.col("c.source").rlike(MAYBE_INSTALL)).select(
        "path", "verified", "c.cell_idx", F.posexplode_outer(tx.lines(F.col("c.source"))).alias("pos", "line")
    )
    return rows.filter(F.col("line").rlike(tx.PIP_LINE) | F.col("line").rlike(tx.DOWNLOAD_LINE)).withColumn(
        "line_no", F.col("pos") + 1
    )


def notebook_supply_chain(notebooks: DataFrame) -> DataFrame:
    """Unpinned installs and unverified downloads of notebooks `(path, content)`."""
    found = install_lines(notebooks).select(
        "path", F.inline_outer(install_line_hits(F.col("line"), F.col("line_no"), F.col("cell_idx"), F.col("verified")))
    )
    return as_findings(found.filter(F.col("rule_id").isNotNull()))


def requirement_line_hit(raw: Column, line_no: Column, path: Column) -> Column:
    """The hit of one line of a requirement list, NULL when it is pinned or names no requirement."""
    line, name = F.regexp_replace(raw, _MARGIN, ""), F.element_at(F.split(path, "/"), -1)
    found = hit("supply_chain.unpinned-requirement", line_no, line_no,
                F.concat(F.lit("`"), line, F.lit("` in "), name, F.lit(" has no version")), raw)
    return F.when(names_requirement(line) & ~tx.is_pinned(line), found)


def requirement_findings(files: DataFrame) -> DataFrame:
    """Requirements without a version, of `(path, content)` requirement lists."""
    found = requirement_lines(files).select(
        "path", requirement_line_hit(F.col("raw"), F.col("line_no"), F.col("path")).alias("h")
    ).filter(F.col("h").isNotNull()).select("path", "h.*")
    return as_findings(found)


def advisory_findings(reports: DataFrame) -> DataFrame:
    """One finding per advisory of `(file, payload)` dependency reports; no line is known."""
    spec = F.concat("name", F.lit("=="), "version")
    fixed = F.array_join("fix_versions", ", ")
    found = read_advisories(reports).select(
        "file", "name", F.lit("supply_chain.known-cve").alias("rule_id"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
        F.concat(F.lit("`"), spec, F.lit("` is affected by "), "vuln_id", F.lit(": "),
                 F.substring("description", 1, 200)).alias("message"),
        F.concat(spec, F.lit(" -> "), "vuln_id").alias("evidence"),
        F.concat(F.lit("Upgrade `"), "name", F.lit("` to "),
                 F.when(fixed == "", F.lit(NO_FIX)).otherwise(fixed), F.lit(".")).alias("fix_text"),
    )
    return as_findings(found, file="file", fix_summary=F.col("fix_text"))


def pattern_findings(reports: DataFrame) -> DataFrame:
    """Findings of `(payload)` pattern-scan reports, with the report's own severity and message."""
    return as_findings(read_pattern_results(reports), file="file", severity=F.col("severity"))


# --- call sites ---------------------------------------------------------------------------------

WANTED = pr.wanted_calls(SHIPPED)


def notebook_facts(notebooks: DataFrame) -> DataFrame:
    """`(path, kind, cell_starts, facts)` of notebooks; cells are joined so imports carry over."""
    read = notebooks.select("path", F.lit("notebook").alias("source_kind"), cs.document_facts(F.col("content"), F.lit(True)).alias("read"))
    return read.select("path", "source_kind", "read.cell_starts", "read.facts")


def python_facts(files: DataFrame) -> DataFrame:
    """The same of plain Python files, which have no cells."""
    return cs.with_call_sites(files, "content", WANTED).select(
        "path", F.lit("python").alias("source_kind"), F.lit(None).cast("array<int>").alias("cell_starts"), "facts"
    )


def corpus_facts(files: DataFrame, declared: Sequence[pr.Rule] = SHIPPED) -> DataFrame:
    """Facts of a mixed corpus `(path, content, source_kind)` in one pass and one parse per file."""
    read = cs.document_facts(F.col("content"), F.col("source_kind") == "notebook", pr.wanted_calls(declared))
    return files.select("path", "source_kind", read.alias("read")).select("path", "source_kind", "read.cell_starts", "read.facts")


def fact_rows(facts: DataFrame) -> DataFrame:
    """One row per fact, with the file's earliest split line and dropped columns beside it.

    Both are found before the explode: beside it, Spark would keep all facts of the file in the row of each fact and
    look through them for every one.
    """
    of_file = facts.select(
        "path", "source_kind", "cell_starts", cs.split_line(F.col("facts")).alias("split_line"),
        cs.dropped_columns(F.col("facts")).alias("dropped"), "facts",
    )
    context = ("path", "source_kind", "cell_starts", "split_line", "dropped")
    return of_file.select(*context, F.posexplode_outer("facts").alias("ord", "f")).filter(F.col("f").isNotNull())


FIT_ON_TEST, FIT_BEFORE_SPLIT, LABEL_PROXY = "leakage.fit-on-test", "leakage.preprocessing-before-split", "leakage.label-proxy-feature"
PICKLE_LOADERS = ("cPickle.load", "pickle.load", "pickle.loads")  # fixed values, sorted


def _is_true(fact: Column, keyword: str) -> Column:
    return F.coalesce(F.try_element_at(fact["kwargs"], F.lit(keyword)) == "True", F.lit(False))


def _may_be(f: Column) -> Column:
    """Names a callee may have; every import counts."""
    return F.coalesce(F.split(f["qualified_name"], cs.ORIGINS), F.array().cast("array<string>"))


def _call_conditions(f: Column, split: Column) -> dict[str, Column]:
    """What each loader and leakage rule asks of a call."""
    may_be, attr = _may_be(f), f["attr"]
    fits = attr.isin(*cs.FIT_METHODS) & ~f["first_arg_is_literal"]
    return {
        "deserialization.unsafe-joblib-load": F.array_contains(may_be, "joblib.load"),
        "deserialization.unsafe-pickle-load": F.arrays_overlap(may_be, F.array(*map(F.lit, PICKLE_LOADERS))),
        "deserialization.unsafe-torch-load": F.array_contains(may_be, "torch.load") & ~_is_true(f, "weights_only"),
        "deserialization.unsafe-numpy-load": F.array_contains(may_be, "numpy.load") & _is_true(f, "allow_pickle"),
        FIT_ON_TEST: attr.isin("fit", "fit_transform") & tx.is_test_name(f["first_arg_name"]),
        FIT_BEFORE_SPLIT: fits & (f["line_start"] < split),
    }


def _asked(rule: str, only: Collection[str] | None) -> bool:
    return only is None or rule in only


def may_hit(
    f: Column, source_kind: Column, split: Column, declared: Sequence[pr.Rule] = SHIPPED, only: Collection[str] | None = None
) -> Column:
    """A cheap test in front of `call_site_hits`: no fact that fails it has a hit."""
    kinds = sorted({kind for r in declared if _asked(r.id, only) for kind in r.kinds})
    conditions = [F.coalesce(c, F.lit(False)) for rule, c in _call_conditions(f, split).items() if _asked(rule, only)]
    of_call = reduce(Column.__or__, [*conditions, *([source_kind.isin(*kinds)] if kinds else [])], F.lit(False))
    return F.when(f["kind"] == "call", of_call).otherwise(F.lit(_asked(LABEL_PROXY, only)))


def call_site_hits(
    f: Column, source_kind: Column, starts: Column, split: Column, dropped: Column, declared: Sequence[pr.Rule] = SHIPPED,
    only: Collection[str] | None = None,
) -> Column:
    """Loader and leakage hits of one fact, and those of the declared rules; of the rules in `only`, where it is given.

    Three line systems meet here: loader rules count lines of the joined cells, leakage rules count
    lines within a code cell (and name it), plain files count their own lines.
    """
    in_notebook = source_kind == "notebook"
    first_line, last_line, arg = f["line_start"], f["line_end"], f["first_arg_name"]
    is_call, attr = f["kind"] == "call", f["attr"]
    pickles = F.array_intersect(_may_be(f), F.array(*map(F.lit, PICKLE_LOADERS)))

    prefix = F.when(in_notebook, F.format_string("[cell %d] ", nb.code_cell_of(first_line, starts))).otherwise("")
    cell_first = F.when(in_notebook, nb.line_in_cell(first_line, starts)).otherwise(first_line)
    cell_last = F.when(in_notebook, nb.line_in_cell(last_line, starts)).otherwise(last_line)
    seen_at = F.when(in_notebook, nb.marked_line(first_line, starts)).otherwise(first_line)
    split_at = F.when(in_notebook, nb.marked_line(split, starts)).otherwise(split)

    def loads(rule: str, message: Column) -> Column:
        return hit(rule, first_line, last_line, message, f["evidence"])

    def leaks(rule: str, order: int, message: Column) -> Column:
        return hit(rule, cell_first, cell_last, F.concat(prefix, message), f["evidence"], order)

    hits = (
        loads("deserialization.unsafe-joblib-load", F.lit("`joblib.load` unpickles the file and runs whatever code it carries")),
        loads("deserialization.unsafe-pickle-load", F.format_string("`%s` runs whatever code the data carries", F.array_join(pickles, cs.ORIGINS))),
        loads("deserialization.unsafe-torch-load", F.lit("`torch.load` without `weights_only=True` unpickles the file")),
        loads("deserialization.unsafe-numpy-load", F.lit("`numpy.load` with `allow_pickle=True` unpickles the file")),
        leaks(FIT_ON_TEST, 1, F.format_string("`%s(%s, ...)` is fitted on test data", attr, arg)),
        leaks(FIT_BEFORE_SPLIT, 3, F.format_string("fitted on the full data (line %d) before the split (line %d)", seen_at, split_at)),
    )
    met = [F.when(c, h) for (rule, c), h in zip(_call_conditions(f, split).items(), hits, strict=True) if _asked(rule, only)]
    of_call = F.array_compact(F.array(*met)) if met else F.expr(NO_HITS)
    by_data = pr.declared_hits(
        [r for r in declared if _asked(r.id, only)], f, source_kind, lambda rule, condition, message: F.when(condition, leaks(rule.id, 4, message)),
    )
    if by_data is not None:
        of_call = F.concat(of_call, by_data)
    if not _asked(LABEL_PROXY, only):
        return F.when(is_call, of_call).otherwise(F.expr(NO_HITS))
    context = F.when(f["kind"] == "annotated", "an annotated assignment").otherwise("an assignment")
    proxies = F.filter(f["strings"], lambda s: tx.is_label_proxy(s) & ~F.array_contains(dropped, s))
    of_assignment = F.transform(proxies, lambda s: hit(
        LABEL_PROXY, cell_first, cell_last,
        F.concat(prefix, F.format_string("column `%s` in %s looks like a proxy of the label", s, context)),
        F.substring(f["evidence"], 1, 200), 2,
    ))
    return F.when(is_call, of_call).otherwise(of_assignment)


def call_site_findings(
    facts: DataFrame, declared: Sequence[pr.Rule] = SHIPPED, only: Collection[str] | None = None
) -> DataFrame:
    """Loader, leakage and declared findings from `notebook_facts` / `python_facts` / `corpus_facts`.

    Where `only` names rules, no hit of another one is built.
    """
    f, kind, split = F.col("f"), F.col("source_kind"), F.col("split_line")
    hits = fact_rows(facts).filter(may_hit(f, kind, split, declared, only)).select("path", "ord", F.posexplode_outer(call_site_hits(
        f, kind, F.col("cell_starts"), split, F.col("dropped"), declared, only
    )).alias("pos", "hit")).filter(F.col("hit").isNotNull())
    return as_findings(dedupe_hits(hits.select("path", F.struct("ord", "pos").alias("place"), "hit.*")), declared=declared)


def declared_findings(files: DataFrame, declared: Sequence[pr.Rule]) -> DataFrame:
    """Findings of declared rules alone on `(path, content, source_kind)`: one parse for all of them."""
    ids = [r.id for r in declared]
    return call_site_findings(corpus_facts(files, declared), declared, only=ids).filter(F.col("rule_id").isin(*ids))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """First hit per rule, file and line for the leakage rules; hits of other checks all stay.

    `(path, place, rule_id, source_order, line_start, …)`, `place` being unique within the file. One
    grouping serves all (a hit that must stay is its own group), so the parse behind it runs once;
    keys are pre-aggregated on the map side, so a file or rule with most of the hits stays cheap.
    """
    own = F.when(F.col("rule_id").rlike(r"^(?:deserialization|supply_chain|secrets)\."), F.col("place"))
    first = F.min_by(F.struct("line_end", "message", "evidence", "source_order", "place"), F.struct("source_order", "place"))
    return hits.groupBy("path", "rule_id", "line_start", own.alias("own")).agg(first.alias("m")).select(
        "path", "rule_id", "line_start", "m.*"
    )


# --- secrets ------------------------------------------------------------------------------------

def secret_hits(text: Column) -> Column:
    """Array of (rule_id, token) over every token format, in the order of the rule table."""
    def of_rule(rule: str, pattern: str) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(tokens, lambda t: F.struct(F.lit(rule).alias("rule_id"), t.alias("token")))

    return F.concat(*[of_rule(rule, pattern) for rule, pattern in SECRET_PATTERNS])


# Every token format has one of these in it; a cheap test before the eight real patterns.
MAYBE_SECRET = r"sk-|AKIA|ASIA|gh[pousr]_|hf_|PRIVATE KEY|xox[abprs]-|://"


def secret_line_hits(line: Column, line_no: Column, saved: Column, where: Column) -> Column:
    """Hits of one line of source or, when `saved`, of a stored output (which has no line)."""
    at = F.when(~saved, line_no)
    message = F.when(saved, "a credential is left in a saved output").otherwise("a credential is written into the source")
    found = F.transform(secret_hits(line), lambda h: hit(
        F.when(saved, "secrets.leaked-in-notebook-output").otherwise(h["rule_id"]), at, at,
        F.concat(message, where), tx.redact(h["token"]),
    ))
    return F.when(line.rlike(MAYBE_SECRET), found).otherwise(F.expr(NO_HITS))


def secret_lines(texts: DataFrame) -> DataFrame:
    """Tokens in `(path, text)`: one row per token with its line."""
    rows = texts.filter(F.col("text").rlike(MAYBE_SECRET)).select(
        "path", F.posexplode_outer(tx.lines(F.col("text"))).alias("pos", "line")
    ).filter(F.col("line").rlike(MAYBE_SECRET))
    return rows.select("path", (F.col("pos") + 1).alias("line_start"), F.inline_outer(secret_hits(F.col("line")))).filter(
        F.col("rule_id").isNotNull()
    )


def secret_findings(texts: DataFrame) -> DataFrame:
    """Tokens written into `(path, text)`."""
    found = secret_lines(texts).select(
        "path", "rule_id", "line_start", F.col("line_start").alias("line_end"),
        F.lit("a credential is written into the source").alias("message"), tx.redact(F.col("token")).alias("evidence"),
    )
    return as_findings(found)


def notebook_secret_findings(notebooks: DataFrame) -> DataFrame:
    """Tokens in the code of notebooks, and tokens left in their saved outputs, from one scan."""
    cells = nb.explode_code_cells(notebooks)
    text = lambda saved, t: F.struct(F.lit(saved).alias("saved"), t.alias("text"))
    parts = cells.select("path", "cell_idx", F.inline(F.concat(
        F.array(text(False, F.col("source"))), F.transform("outputs", lambda o: text(True, o)),
    ))).filter(F.col("text").rlike(MAYBE_SECRET))
    rows = parts.select("path", "cell_idx", "saved", F.posexplode_outer(tx.lines(F.col("text"))).alias("pos", "line"))
    where = F.format_string(" (cell %d)", F.col("cell_idx"))
    found = rows.filter(F.col("line").rlike(MAYBE_SECRET)).select(
        "path", F.inline_outer(secret_line_hits(F.col("line"), F.col("pos") + 1, F.col("saved"), where))
    )
    return as_findings(found.filter(F.col("rule_id").isNotNull()))


def union_findings(*parts: DataFrame) -> DataFrame:
    """All findings in one table, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b), parts)
