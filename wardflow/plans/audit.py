"""Corpus audit: every file is read, split and parsed once for all checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordering import number_rows
from ..operators import callsites as cs
from ..operators import rules
from ..operators.pattern_rules import Rule, wanted_calls
from ..operators.findings import check_rank, default_check_runs, synthesise_scenarios
from ..sources import notebooks as nb
from ..operators.unreadable import unreadable
from ..sources.files import CORPUS, decoded, file_kind, read_corpus, read_files
from ..sources.requirements import numbered_lines

_LINE_UNITS = ("code", "output", "requirements")
# The rules of the first two see facts of parsed texts only, those of the others lines only.
_PARSED_CHECKS, _LINE_CHECKS = ("deserialization", "leakage"), ("supply_chain", "secrets")
_MAYBE = f"{rules.MAYBE_INSTALL}|{rules.MAYBE_SECRET}"


def _units(kind: Column) -> Column:
    """What is looked at in a file: each code cell, each text of a saved output, and the whole text to parse."""
    def unit(name: str, text: Column, cell: Column | None = None) -> Column:
        cell = F.lit(None).cast("int") if cell is None else cell
        return F.struct(F.lit(name).alias("unit"), cell.alias("cell_idx"), text.alias("text"))

    code = F.col("code")
    of_notebook = F.concat(
        F.transform(code, lambda c: unit("code", c["source"], c["cell_idx"])),
        F.flatten(F.transform(code, lambda c: F.transform(c["outputs"], lambda text: unit("output", text, c["cell_idx"])))),
        F.array(unit("module", nb.module_text(code))),
    )
    of_python = F.array(unit("code", F.col("content")), unit("module", F.col("content")))
    of_requirements = F.array(unit("requirements", F.col("content")))
    return F.when(kind == "notebook", of_notebook).when(kind == "python", of_python).when(kind == "requirements", of_requirements)


def _line_hits(line: Column, line_no: Column) -> Column:
    unit, in_notebook = F.col("unit"), F.col("source_kind") == "notebook"
    saved = unit == "output"
    where = F.when(in_notebook, F.format_string(" (cell %d)", F.col("cell_idx"))).otherwise("")
    install = F.when(
        (unit == "code") & in_notebook, rules.install_line_hits(line, line_no, F.col("cell_idx"), F.col("verified"))
    ).otherwise(F.expr(rules.NO_HITS))
    requirement = F.when(
        unit == "requirements", F.array_compact(F.array(rules.requirement_line_hit(line, line_no, F.col("path"))))
    ).otherwise(F.expr(rules.NO_HITS))
    secret = F.when(unit != "requirements", rules.secret_line_hits(line, line_no, saved, where)).otherwise(F.expr(rules.NO_HITS))
    return F.concat(install, requirement, secret)


def corpus_hits(files: DataFrame, declared: Sequence[Rule] = rules.SHIPPED, check: str | None = None) -> DataFrame:
    """Hits of all file-based checks and of the declared rules on `(path, content)`, in one scan without a shuffle.

    Files become units by a projection; line rules and the parser (which sees only the units worth
    parsing) run on the same rows. Where the column `check` names the one check a file is for, only the units
    that this check looks at are kept; the hits may hold those of other checks on the same units.
    """
    asked = wanted_calls(declared)
    own = [] if check is None else [F.col(check).alias("own_check")]
    kind = file_kind(F.col("path"))
    opened = (
        files.select("path", "content", kind.alias("source_kind"), *own).filter(F.col("source_kind").isNotNull())
        .withColumn("code", nb.code_cells(F.when(F.col("source_kind") == "notebook", F.col("content"))))
    )
    units = opened.select(
        "path", "source_kind", rules.verifies_downloads(F.col("code")).alias("verified"),
        F.when(F.col("source_kind") == "notebook", nb.cell_starts(F.col("code"))).alias("cell_starts"),
        *(["own_check"] if own else []), F.posexplode_outer(_units(F.col("source_kind"))).alias("unit_no", "u"),
    ).select("path", "source_kind", "verified", "cell_starts", *(["own_check"] if own else []), "unit_no", "u.*")
    is_module = F.col("unit") == "module"
    if own:
        units = units.filter(F.when(is_module, F.col("own_check").isin(*_PARSED_CHECKS)).otherwise(F.col("own_check").isin(*_LINE_CHECKS)))
    wanted = F.when(is_module, cs.worth_parsing(F.col("text"), asked)).when(
        F.col("unit") == "requirements", F.lit(True)
    ).otherwise(F.col("text").rlike(_MAYBE))
    facts = cs.with_call_sites(
        units.filter(wanted).withColumn("module", F.when(is_module, F.col("text"))), wanted=asked,
    ).withColumn("split_line", cs.split_line(F.col("facts"))).withColumn("dropped", cs.dropped_columns(F.col("facts")))
    rows = F.when(F.col("unit") == "requirements", numbered_lines(F.col("text"))).otherwise(tx.lines(F.col("text")))
    by_line = F.flatten(F.transform(rows, lambda line, i: _line_hits(line, i + 1)))
    by_fact = F.flatten(F.transform("facts", lambda f: rules.call_site_hits(
        f, F.col("source_kind"), F.col("cell_starts"), F.col("split_line"), F.col("dropped"), declared
    )))
    found = facts.select("path", "unit_no", F.posexplode_outer(F.when(is_module, by_fact).otherwise(by_line)).alias("pos", "hit"))
    return found.filter(F.col("hit").isNotNull()).select("path", F.struct("unit_no", "pos").alias("place"), "hit.*")


def audit_findings(files: DataFrame, run_id: str, *others: DataFrame, declared: Sequence[Rule] = rules.SHIPPED) -> DataFrame:
    """All findings of a run with their list position `seq`; `others` are findings of tool reports."""
    hits = rules.dedupe_hits(corpus_hits(files, declared))
    parts = [rules.as_findings(hits, declared=declared)] + list(others)
    found = rules.union_findings(*parts).withColumn("run_id", F.lit(run_id))
    order = [check_rank(F.col("check")), F.col("file"), F.coalesce("line_start", F.lit(0)), F.col("rule_id"), F.col("message"), F.col("evidence")]
    numbered = number_rows(found, order, "seq")
    return numbered.withColumn("seq", F.col("seq") - 1)


def audit_path(
    spark: SparkSession, path: str, run_id: str, *others: DataFrame, declared: Sequence[Rule] = rules.SHIPPED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings (scenarios included, after the others), check rows and unreadable inputs of everything below a path.

    `declared` are the rules given as data (`operators.pattern_rules.read_rules`); by default those of the library.

    The adversarial check works on a scored model, so it counts as run only when `others` hold findings of it;
    otherwise its row says `not_run`.
    """
    found = audit_findings(read_corpus(spark, path), run_id, *others, declared=declared)
    chained = synthesise_scenarios(found).withColumn("seq", F.lit(None).cast("bigint"))
    scored = found.filter(F.col("check") == "adversarial").select(F.lit(run_id).alias("run_id"), "check").distinct()
    checks = default_check_runs(found, run_id).join(scored.withColumn("scored", F.lit(True)), ["run_id", "check"], "left").withColumn(
        "tool_status", F.when((F.col("check") == "adversarial") & F.col("scored").isNull(), "not_run").otherwise(F.col("tool_status"))
    ).drop("scored")
    return found.unionByName(chained), checks, unreadable(decoded(read_files(spark, path, CORPUS)))


# --- checks one by one --------------------------------------------------------------------------

def _of_kind(files: DataFrame, *kinds: str) -> DataFrame:
    return files.filter(file_kind(F.col("path")).isin(*kinds))


def supply_chain(files: DataFrame) -> DataFrame:
    return rules.union_findings(
        rules.notebook_supply_chain(_of_kind(files, "notebook")),
        rules.requirement_findings(_of_kind(files, "requirements")),
    )


def call_sites(files: DataFrame) -> DataFrame:
    sources = _of_kind(files, "notebook", "python").withColumn("source_kind", file_kind(F.col("path")))
    return rules.call_site_findings(rules.corpus_facts(sources))


def deserialization(files: DataFrame) -> DataFrame:
    return call_sites(files).filter(F.col("check") == "deserialization")


def leakage(files: DataFrame) -> DataFrame:
    return call_sites(files).filter(F.col("check") == "leakage")


def secrets(files: DataFrame) -> DataFrame:
    plain = _of_kind(files, "python").withColumnRenamed("content", "text")
    return rules.union_findings(
        rules.notebook_secret_findings(_of_kind(files, "notebook")), rules.secret_findings(plain)
    )


# The single dispatch table of file-based checks: `(path, content)` to findings. The adversarial
# check works on a scored model instead of files, see operators.explain.
# `deserialization` and `leakage` are two views of `call_sites`: run `call_sites` once where both are wanted.
CHECK_RUNNERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "supply_chain": supply_chain,
    "deserialization": deserialization,
    "secrets": secrets,
    "leakage": leakage,
}


def run_checks(files: DataFrame, checks: Sequence[str] = tuple(CHECK_RUNNERS)) -> DataFrame:
    """Findings of the checks asked for; those that are views of `call_sites` share one parse."""
    views = [c for c in checks if c in _PARSED_CHECKS]
    parts = [CHECK_RUNNERS[c](files) for c in checks if c not in views]
    if len(views) == 1:
        parts.append(CHECK_RUNNERS[views[0]](files))
    elif views:
        parts.append(call_sites(files).filter(F.col("check").isin(*views)))
    return rules.union_findings(*parts)
