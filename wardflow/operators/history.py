"""Run history: Parquet tables, commit files that say which of their rows count, and the questions asked of them.

A write puts all its rows under a batch folder of its own, then commits run by run with a file named after the run,
which only one writer can create. Readers keep the rows of committed (batch, run) pairs, so a write that was killed
is invisible, a retry writes only what is not committed yet, and of two writers of one run the first counts.
Keys come from ranges that a writer claims the same way. `findings` and `fix_proposals` are partitioned by run, so a
question about one run reads only that run's files; within them rows are sorted by rule, and `rule_runs` says which
runs have a rule at all, so a rule's history opens only those.
"""

from __future__ import annotations

import json
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import commits
from ..functions.ordering import number_rows
from ..session import collect_bounded
from .findings import check_rank, severity_summary

NEWEST_RUNS = 200
RUNS_AT_ONCE = 100_000  # runs that one write may hold
COMMIT = "run_id string, batch string, first_key bigint, findings bigint"
# Columns of each table; the batch, and for the first two the run, are folder names.
TABLES = {
    "findings": "finding_pk bigint, rule_id string, check_name string, severity string, category string, file string, line_start int, line_end int, "
                "message string, evidence string, batch string, run_id string",
    "fix_proposals": "finding_pk bigint, summary string, confidence string, diff string, replacement string, author string, batch string, run_id string",
    "check_results": "run_id string, check_name string, duration_ms bigint, tool_status string, findings_count bigint, batch string",
    "runs": "run_id string, target string, started_at string, finished_at string, total_findings bigint, max_severity string, blocking boolean, "
            "invocation string, extra map<string, string>, batch string",
    "rule_runs": "rule_id string, run_id string, findings bigint, batch string",
}


def iso_utc(moment: Column) -> Column:
    """UTC ISO-8601 with seconds; the session time zone is UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def number_findings(findings: DataFrame, after: int = 0) -> DataFrame:
    """Add `finding_pk`, counting on from `after` in run, check and list order."""
    order = [F.col("run_id"), check_rank(F.col("check")), F.col("seq")]
    numbered = number_rows(findings, order, "finding_pk")
    return numbered.withColumn("finding_pk", F.col("finding_pk") + after)


def build_runs(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Run rows: `runs` `(run_id, target, started_at, finished_at, invocation, extra)` with totals."""
    totals = findings.groupBy("run_id").agg(*severity_summary())
    return runs.join(totals, "run_id", "left").select(
        "run_id", "target", iso_utc(F.col("started_at")).alias("started_at"),
        iso_utc(F.col("finished_at")).alias("finished_at"),
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"), "max_severity",
        F.coalesce("blocking", F.lit(False)).alias("blocking"), "invocation", "extra",
    )


def build_check_results(findings: DataFrame, check_runs: DataFrame) -> DataFrame:
    counts = findings.groupBy("run_id", "check").agg(F.count("*").alias("n"))
    return check_runs.join(counts, ["run_id", "check"], "left").select(
        "run_id", F.col("check").alias("check_name"), "duration_ms", "tool_status",
        F.coalesce("n", F.lit(0)).alias("findings_count"),
    )


def build_findings(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "finding_pk", "run_id", "rule_id", F.col("check").alias("check_name"), "severity", "category", "file",
        "line_start", "line_end", "message", "evidence",
    )


def build_fixes(numbered: DataFrame, author: str = "deterministic") -> DataFrame:
    """One row per finding that proposes a fix, keyed by the finding."""
    return numbered.filter(F.col("fix").isNotNull()).select(
        "run_id", "finding_pk", F.col("fix.summary").alias("summary"), F.col("fix.confidence").alias("confidence"),
        F.col("fix.diff").alias("diff"), F.col("fix.replacement").alias("replacement"), F.lit(author).alias("author"),
    )


def claim_keys(spark: SparkSession, root: str, count: int) -> int:
    """Claim the next `count` keys for one writer; the range starts behind the result. Unused ranges leave gaps."""
    folder = f"{root}/keys"
    commits.make_folder(spark, folder)
    while True:
        last = commits.names(spark, folder)[-1:]
        start = json.loads(commits.read_text(spark, f"{folder}/{last[0]}"))["end"] if last else 0
        if not count:  # nothing to claim, and a file that ends where it starts would block the next claim
            return start
        if commits.create_once(spark, f"{folder}/{start:020d}", json.dumps({"end": start + count})):
            return start


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """`(run_id, batch, first_key, findings)` of every run that counts."""
    commits.make_folder(spark, f"{root}/commits")
    return spark.read.schema(COMMIT).json(f"{root}/commits")


def record_runs(root: str, findings: DataFrame, runs: DataFrame, check_runs: DataFrame) -> list[str]:
    """Add finished runs to the history below `root`; ids of the runs that this write added.

    Runs that are committed already are left out, so the same call can be made again after a failure. If another writer
    commits a run in the meantime, that one stays and ours does not count. A run may have no findings or no run row.
    """
    spark = findings.sparkSession
    known = committed_runs(spark, root).select("run_id")
    findings, runs, check_runs = (df.join(known, "run_id", "left_anti") for df in (findings, runs, check_runs))
    numbered = number_findings(findings)  # checkpointed: all tables come from these rows
    sizes = numbered.groupBy("run_id").agg(F.count("*").alias("n"), F.min("finding_pk").alias("first"))
    asked = runs.select("run_id").distinct().join(sizes, "run_id", "full").select("run_id", F.coalesce("n", F.lit(0)).alias("n"), "first")
    new = sorted(collect_bounded(asked.filter("run_id IS NOT NULL"), RUNS_AT_ONCE, "runs of one write"), key=lambda r: r["run_id"])
    if not new:
        return []
    start, batch = claim_keys(spark, root, sum(r["n"] for r in new)), uuid4().hex
    numbered = numbered.withColumn("finding_pk", F.col("finding_pk") + start)

    def write(name: str, df: DataFrame, *by: str) -> None:
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{root}/{name}/batch={batch}")

    by_rule = lambda df, *order: df.sortWithinPartitions(*order)
    write("findings", by_rule(build_findings(numbered), "run_id", "rule_id"), "run_id")
    write("fix_proposals", build_fixes(numbered), "run_id")
    write("check_results", build_check_results(numbered, check_runs))
    write("runs", build_runs(numbered, runs))
    write("rule_runs", by_rule(numbered.groupBy("rule_id", "run_id").agg(F.count("*").alias("findings")), "rule_id"))
    added = []
    for run in new:
        first = None if run["first"] is None else run["first"] + start
        line = {"run_id": run["run_id"], "batch": batch, "first_key": first, "findings": run["n"]}
        if commits.create_once(spark, f"{root}/commits/{quote(run['run_id'], safe='')}.json", json.dumps(line)):
            added.append(run["run_id"])
    return added


def read_history(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables, committed rows only: one join with a row per run, in which folders of other batches and runs drop out."""
    counted = committed_runs(spark, root).select("batch", "run_id")
    tables = {}
    for name, schema in TABLES.items():
        commits.make_folder(spark, f"{root}/{name}")
        tables[name] = spark.read.schema(schema).parquet(f"{root}/{name}").join(counted, ["batch", "run_id"], "left_semi").drop("batch")
    return tables


def remove_uncommitted(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders of batches that no commit names; not to be called while a writer is at work."""
    kept = {r["batch"] for r in collect_bounded(committed_runs(spark, root).select("batch").distinct(), RUNS_AT_ONCE, "batches")}
    stale = {(name, folder) for name in TABLES for folder in commits.names(spark, f"{root}/{name}") if folder.removeprefix("batch=") not in kept}
    for name, folder in stale:
        commits.remove_folder(spark, f"{root}/{name}/{folder}")
    return sorted({folder.removeprefix("batch=") for _, folder in stale})


def list_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first."""
    return runs.orderBy(F.desc("started_at"), F.asc("run_id")).limit(limit)


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def findings_for_run(findings: DataFrame, fixes: DataFrame, run_id: str) -> DataFrame:
    """Findings of a run with their fix, in key order; both sides prune to the run's partition."""
    mine = findings.filter(F.col("run_id") == run_id)
    proposals = fixes.filter(F.col("run_id") == run_id).select(
        "finding_pk", *[F.col(c).alias(f"fix_{c}") for c in ("summary", "confidence", "diff", "replacement")]
    )
    return mine.join(proposals, "finding_pk", "left").orderBy("finding_pk")


def runs_by_rule(findings: DataFrame, runs: DataFrame, rule_id: str, rule_runs: DataFrame | None = None) -> DataFrame:
    """Every appearance of a rule, newest run first; `rule_runs` tells which runs' files are worth opening."""
    seen = findings.filter(F.col("rule_id") == rule_id)
    if rule_runs is not None:
        seen = seen.join(rule_runs.filter(F.col("rule_id") == rule_id).select("run_id"), "run_id", "left_semi")
    return (
        seen.select("run_id", "severity", "file", "line_start")
        .join(runs.select("run_id", "target", "started_at"), "run_id")
        .select("run_id", "target", "started_at", "severity", "file", "line_start")
        .orderBy(F.desc("started_at"), "run_id", "file", "line_start")
    )


def show_run(runs: DataFrame, prefix: str, newest: int = NEWEST_RUNS) -> DataFrame:
    """Newest runs whose id starts with prefix, each with the number of matches (1 is the good case)."""
    found = list_runs(runs, newest).filter(F.col("run_id").startswith(prefix))
    return found.withColumn("matches", F.count("*").over(Window.partitionBy()))  # at most `newest` rows


def append_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("append").parquet(path)
