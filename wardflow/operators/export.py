"""Interchange documents of findings (SARIF 2.1.0, the public OASIS format) and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text as tx
from .findings import SNIPPET_LENGTH

SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/cos02/schemas/sarif-schema-2.1.0.json"
TOOL_NAME = "wardflow"


def rule_descriptors(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per rule id with the attributes of its first finding, in `seq` order."""
    order = F.struct("run_id", "seq")
    first = findings.groupBy(*by, "rule_id").agg(
        F.min_by(F.struct("category", "severity", "check"), order).alias("f")
    )
    return first.select(
        *by, "rule_id", tx.pascal_case(F.col("rule_id")).alias("name"), F.col("f.category").alias("category"),
        sev.report_level(F.col("f.severity")).alias("level"),
        sev.security_score(F.col("f.severity")).alias("security_severity"), F.col("f.check").alias("check"),
    )


def descriptor_json() -> Column:
    return F.to_json(F.struct(
        F.col("rule_id").alias("id"), "name", F.struct(F.col("category").alias("text")).alias("shortDescription"),
        F.struct(F.concat(F.lit("Detects "), "rule_id", F.lit(".")).alias("text")).alias("fullDescription"),
        F.struct("level").alias("defaultConfiguration"),
        F.struct(F.col("security_severity").alias("security-severity"),
                 F.array(F.lit("security"), F.lit("ml"), F.col("check")).alias("tags")).alias("properties"),
    ))


def result_json(root: str | None = None) -> Column:
    """A finding as one result object; absent lines, snippets and fixes leave no key behind."""
    uri = F.struct(tx.relative_path(F.col("file"), root).alias("uri"))
    lines = F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"))
    has_line = F.col("line_start").isNotNull() | F.col("line_end").isNotNull()
    snippet = F.when(F.col("evidence") != "", F.struct(F.substring("evidence", 1, SNIPPET_LENGTH).alias("text")))
    region = F.when(has_line | (F.col("evidence") != ""), F.struct(
        F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"), snippet.alias("snippet")))
    replacement = F.struct(
        F.struct(F.col("fix.replacement").alias("text")).alias("insertedContent"),
        F.when(has_line, lines).alias("deletedRegion"),
    )
    fixes = F.when(F.col("fix.replacement").isNotNull(), F.array(F.struct(
        F.struct(F.col("fix.summary").alias("text")).alias("description"),
        F.array(F.struct(uri.alias("artifactLocation"), F.array(replacement).alias("replacements"))).alias("artifactChanges"),
    )))
    return F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), sev.report_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(uri.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(
            sev.security_score(F.col("severity")).alias("security-severity"), "category", "check",
            F.col("fix.confidence").alias("fixConfidence"), F.col("fix.summary").alias("fixDescription"),
        ).alias("properties"),
        fixes.alias("fixes"),
    ))


def sarif_lines(findings: DataFrame, check_runs: DataFrame, root: str | None = None, version: str = "0.1.0") -> DataFrame:
    """Each run's document as text lines `(run_id, part, ord, key, line)`.

    Read in (part, ord, key) order the lines of a run are one SARIF document. Results stay one row each,
    so a run with a third of all findings is written by many tasks.
    """
    runs = check_runs.select("run_id").distinct()
    head = runs.select("run_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("key"), F.lit(
        f'{{"version":"{SARIF_VERSION}","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":{{"name":"{TOOL_NAME}",'
        f'"semanticVersion":"{version}","rules":['
    ).alias("line"))
    described = rule_descriptors(findings, ("run_id",))
    # Joined by run and rule (or run and position), not by run alone: a run may hold most of the rows.
    first_rule = described.groupBy("run_id").agg(F.min("rule_id").alias("rule_id")).withColumn("_first", F.lit(True))
    rules = described.join(first_rule, ["run_id", "rule_id"], "left").select(
        "run_id", F.lit(1).alias("part"),
        F.lit(0).cast("long").alias("ord"), F.col("rule_id").alias("key"),
        F.concat(F.when(F.col("_first"), "").otherwise(","), descriptor_json()).alias("line"),
    )
    middle = runs.select("run_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("key"), F.lit(']}},"results":[').alias("line"))
    first_seq = findings.groupBy("run_id").agg(F.min("seq").alias("seq")).withColumn("_first", F.lit(True))
    results = findings.join(first_seq, ["run_id", "seq"], "left").select(
        "run_id", F.lit(3).alias("part"), F.col("seq").cast("long").alias("ord"), F.lit("").alias("key"),
        F.concat(F.when(F.col("_first"), "").otherwise(","), result_json(root)).alias("line"),
    )
    status = F.to_json(F.struct(
        F.struct(F.concat("check", F.lit(".status")).alias("id")).alias("descriptor"), F.lit("note").alias("level"),
        F.struct(F.format_string("check=%s status=%s duration_ms=%d", "check", "tool_status", "duration_ms").alias("text")).alias("message"),
    ))
    notes = check_runs.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(status)), ",").alias("notes"))
    tail = notes.select("run_id", F.lit(4).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("key"), F.concat(
        F.lit('],"invocations":[{"executionSuccessful":true,"toolExecutionNotifications":['), "notes", F.lit("]}]}]}")
    ).alias("line"))
    return head.unionByName(rules).unionByName(middle).unionByName(results).unionByName(tail)


def write_sarif(lines: DataFrame, path: str) -> None:
    """Part files below `run_id=…` that, concatenated in name order, are the run's document."""
    order = [F.col(c) for c in ("run_id", "part", "ord", "key")]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("run_id", "line").write.mode(
        "overwrite"
    ).partitionBy("run_id").text(path)
