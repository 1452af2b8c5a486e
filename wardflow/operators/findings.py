"""Findings algebra: dedupe, adjudication, scenarios, summaries and report orders.

A findings table carries `run_id`, a position `seq` unique within its run (list order), and the
columns of `schemas.FINDING`. Groups here may be huge (one run, rule or file with a third of all
rows), so everything is a map-side combinable aggregate; nothing sorts or collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CHECKS, scenarios, values_df
from ..functions import severity as sev
from ..functions import text as tx
from .rules import fix_struct

AGGREGATE_FILE = "<aggregate>"
SNIPPET_LENGTH = 400


def keep_first(findings: DataFrame, order: Column) -> DataFrame:
    """One row per (run, rule, file, line): the first in `order`; rows without a line all stay.

    `order` is a number that no two findings of a run share. Its minimum per group is a hash aggregate over the
    keys alone; the rows themselves are only joined to it.
    """
    marked = findings.withColumn("_order", order)
    keys = ["run_id", "rule_id", "file", "line_start"]
    first = marked.filter(F.col("line_start").isNotNull()).groupBy(*keys).agg(F.min("_order").alias("_order")).select("run_id", "_order")
    with_line = marked.filter(F.col("line_start").isNotNull()).join(first, ["run_id", "_order"], "left_semi")
    return with_line.unionByName(marked.filter(F.col("line_start").isNull())).select(*findings.columns)


# --- summaries ----------------------------------------------------------------------------------

def severity_summary(*extra: Column) -> list[Column]:
    """Total, highest severity (NULL without findings) and whether anything blocks."""
    position = sev.rank(F.col("severity"))
    return [
        F.count("severity").alias("total_findings"),
        F.max_by("severity", position).alias("max_severity"),
        F.coalesce(F.max(F.when(F.col("severity").isNotNull(), position)) >= sev.BLOCKING_RANK, F.lit(False)).alias("blocking"),
        *extra,
    ]


def run_summary(findings: DataFrame) -> DataFrame:
    """One row per run."""
    return findings.groupBy("run_id").agg(*severity_summary())


def check_summary(findings: DataFrame, check_runs: DataFrame) -> DataFrame:
    """One row per executed check `(run_id, check, tool_status, duration_ms)`, clean ones included.

    Findings are counted before the join, so the join never sees more rows than checks.
    """
    counts = findings.groupBy("run_id", "check").agg(*severity_summary())
    total = F.coalesce("total_findings", F.lit(0))
    status = F.when(total > 0, "issues").when(F.col("tool_status") != "ok", F.col("tool_status")).otherwise("clean")
    return check_runs.join(counts, ["run_id", "check"], "left").select(
        "run_id", "check", total.alias("findings"), "max_severity", "duration_ms", status.alias("status")
    )


def check_order() -> list[Column]:
    """Worst check first; a clean check ranks as info."""
    return [F.desc(sev.rank(F.coalesce("max_severity", F.lit("info")))), F.asc("check")]


def finding_order() -> list[Column]:
    """Worst finding first, then rule, file and line (none counts as 0)."""
    return [F.desc(sev.rank(F.col("severity"))), F.asc("rule_id"), F.asc("file"),
            F.asc(F.coalesce("line_start", F.lit(0)))]


def rule_counts(findings: DataFrame) -> DataFrame:
    """Detections per rule and file."""
    return findings.groupBy("rule_id", "file").agg(F.count("*").alias("detections"))


def bucket_by_check(findings: DataFrame) -> DataFrame:
    """Findings per check and run; checks without findings do not appear."""
    return findings.groupBy("run_id", "check").agg(F.count("*").alias("findings"))


def run_delta(findings: DataFrame, before: str, after: str) -> DataFrame:
    """Findings per check in two runs, the change and the change in percent (NULL from zero)."""
    def counted(run):
        return F.count_if(F.col("run_id") == run)

    both = findings.filter(F.col("run_id").isin(before, after)).groupBy("check").agg(
        counted(before).alias("before"), counted(after).alias("after")
    )
    change = F.col("after") - F.col("before")
    return both.select(
        "check", "before", "after", change.alias("delta"),
        F.round(F.try_divide(change * 100.0, F.col("before")), 2).alias("delta_pct"),
    )


# --- scenarios ----------------------------------------------------------------------------------

def fired_rules(findings: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Distinct rules per run."""
    return findings.groupBy(*by, "rule_id").agg(F.count("*").alias("detections"))


def synthesise_scenarios(findings: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Threat scenarios whose required rules all fired in the run (or in each file, with `by`).

    Findings shrink to one row per run and rule before anything else; what is collected per run is
    bounded by the number of rules the scenarios name.
    """
    table = scenarios(findings.sparkSession)
    member = table.select("scenario_id", F.explode("required").alias("rule_id"), F.lit(True).alias("needed")).unionByName(
        table.select("scenario_id", F.explode("amplifiers").alias("rule_id"), F.lit(False).alias("needed"))
    )
    fired = findings.groupBy(*by, "rule_id").agg(
        F.min("seq").alias("first_seq"), F.min_by("file", "seq").alias("first_file")
    )
    matched = fired.join(member, "rule_id").groupBy(*by, "scenario_id").agg(
        F.count_if("needed").alias("hits"),
        F.count_if(~F.col("needed")).alias("amplifier_hits"),
        F.min_by("first_file", F.when(F.col("needed"), F.col("first_seq"))).alias("anchor"),
        F.array_sort(F.collect_set("rule_id")).alias("chained"),
    )
    chained = F.array_join("chained", ", ")
    return (
        matched.join(table, "scenario_id").filter(F.col("hits") == F.size("required"))
        .select(
            *by, F.col("scenario_id").alias("rule_id"), F.lit("scenario").alias("check"),
            sev.bump(F.col("baseline"), F.col("amplifier_hits").cast("int")).alias("severity"),
            F.lit("threat-scenario").alias("category"), F.coalesce("anchor", F.lit(AGGREGATE_FILE)).alias("file"),
            F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
            F.format_string("%s. %s (amplifiers triggered: %d)", "name", "narrative", "amplifier_hits").alias("message"),
            F.concat(F.lit("chained findings: "), chained).alias("evidence"),
            fix_struct(F.col("fix"), F.lit("high")).alias("fix"),
        )
    )


# --- adjudication -------------------------------------------------------------------------------

_KEY = ["run_id", "rule_id", "file", "line_start"]


def first_match(findings: DataFrame) -> DataFrame:
    """The first finding of each (run, rule, file, line): the one a verdict on that key is about."""
    return findings.groupBy(*_KEY).agg(F.min("seq").alias("seq"))


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    equal = [left[c] == right[c] for c in _KEY[:-1]] + [left["line_start"].eqNullSafe(right["line_start"])]
    return equal[0] & equal[1] & equal[2] & equal[3]


def match_verdicts(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdicts with the `seq` of their finding; NULL marks one that names no finding (an error row)."""
    target = first_match(findings)
    joined = verdicts.alias("v").join(target, _same_key(verdicts, target), "left")
    return joined.select("v.*", target["seq"].alias("seq"))


def verdict_evidence(confirmed: Column, confidence: Column, reasoning: Column) -> Column:
    """The line a verdict adds to the finding's evidence."""
    word = F.when(confirmed, "True").otherwise("False")
    return F.concat(F.lit("\n[LLM judgement] confirmed="), word, F.lit(" confidence="), confidence, F.lit(": "), reasoning)


def evidence_log(matched: DataFrame) -> DataFrame:
    """Appended evidence as rows `(run_id, seq, ord, added)`, to be read in `ord` order."""
    return matched.filter(F.col("seq").isNotNull()).select(
        "run_id", "seq", "ord", verdict_evidence(F.col("confirmed"), F.col("confidence"), F.col("reasoning")).alias("added")
    )


def adjudicate(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings after all verdicts on them; the input rows themselves stay as they were.

    Applying verdicts one after the other only depends on how many rejected the finding and on
    whether any confirmed it with high confidence, so counts replace an ordered fold and a finding
    with very many verdicts never meets in one task. Appended evidence stays in `evidence_log`.
    """
    effects = match_verdicts(verdicts, findings).filter(F.col("seq").isNotNull()).groupBy("run_id", "seq").agg(
        F.count("*").alias("verdicts"),
        F.count_if(~F.col("confirmed")).alias("_rejections"),
        F.bool_or(F.col("confirmed") & (F.col("confidence") == "high")).alias("_assured"),
    )
    assured = F.coalesce("_assured", F.lit(False)) & F.col("fix").isNotNull()
    return (
        findings.join(effects, ["run_id", "seq"], "left")
        .withColumn("severity", sev.downgrade(F.col("severity"), F.coalesce("_rejections", F.lit(0)).cast("int")))
        .withColumn("fix", F.when(assured, F.col("fix").withField("confidence", F.lit("high"))).otherwise(F.col("fix")))
        .withColumn("verdicts", F.coalesce("verdicts", F.lit(0)))
        .drop("_rejections", "_assured")
    )


def attach_narratives(narratives: DataFrame, findings: DataFrame) -> DataFrame:
    """Fix narratives `(run_id, ord, finding_idx, narrative)` with their finding by position.

    An index outside the run keeps its row with `error`, and the size of the run in `detail`.
    """
    sizes = findings.groupBy("run_id").agg(F.count("*").alias("_size"))
    target = findings.select("run_id", F.col("seq").alias("finding_idx"), "rule_id", "file", "line_start", F.lit(True).alias("_hit"))
    out_of_range = F.col("_hit").isNull()
    detail = F.format_string(
        "no finding at position %d of a run of %d", "finding_idx", F.coalesce("_size", F.lit(0))
    )
    return (
        narratives.join(target, ["run_id", "finding_idx"], "left").join(sizes, "run_id", "left")
        .select("run_id", "ord", "finding_idx", "rule_id", "file", "line_start", "narrative",
                F.when(out_of_range, "unknown_finding").alias("error"), F.when(out_of_range, detail).alias("detail"))
    )


# --- audit assembly -----------------------------------------------------------------------------

def check_rank(check: Column) -> Column:
    """Position of a check in run order."""
    return F.array_position(F.array(*[F.lit(c) for c in CHECKS]), check)


def default_check_runs(findings: DataFrame, run_id: str, durations: dict[str, int] | None = None) -> DataFrame:
    """Run rows for every check, for an audit that ran all of them."""
    rows = [(run_id, c, "ok", (durations or {}).get(c, 0)) for c in CHECKS]
    return values_df(findings.sparkSession, ("run_id", "`check`", "tool_status", "duration_ms"), rows)
