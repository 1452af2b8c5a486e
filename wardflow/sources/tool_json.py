"""Reports of external scanners. Entries of the wrong shape are skipped one by one, not per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.text import normalise_rule_id

UNKNOWN_VERSION = "<unknown>"
UNKNOWN_ID = "UNKNOWN"
NO_DESCRIPTION = "see advisory for details."


def read_advisories(reports: DataFrame) -> DataFrame:
    """Dependency advisories of `(file, payload)`: one row per vulnerability, defaults filled in."""
    deps = reports.select("file", F.expr(
        "explode(try_variant_get(try_parse_json(payload), '$.dependencies', 'array<variant>')) AS dep"
    )).filter("schema_of_variant(dep) LIKE 'OBJECT%'")
    vulns = deps.select("file", F.expr("try_variant_get(dep, '$.name', 'string') AS name"),
                        F.expr("try_variant_get(dep, '$.version', 'string') AS version"),
                        F.expr("explode(try_variant_get(dep, '$.vulns', 'array<variant>')) AS vuln"))
    return vulns.filter("schema_of_variant(vuln) LIKE 'OBJECT%'").select(
        "file",
        F.coalesce("name", F.lit(UNKNOWN_VERSION)).alias("name"),
        F.coalesce("version", F.lit(UNKNOWN_VERSION)).alias("version"),
        F.expr(f"coalesce(try_variant_get(vuln, '$.id', 'string'), '{UNKNOWN_ID}') AS vuln_id"),
        F.expr("coalesce(try_variant_get(vuln, '$.fix_versions', 'array<string>'), array()) AS fix_versions"),
        F.expr(
            "coalesce(nullif(trim(try_variant_get(vuln, '$.description', 'string')), ''), "
            f"'{NO_DESCRIPTION}') AS description"
        ),
    )


def read_pattern_results(reports: DataFrame) -> DataFrame:
    """Pattern-scan results of `(payload)` that have a text id and path and whole line numbers."""

    def typed(path: str, kind: str, out: str) -> str:
        return f"CASE WHEN schema_of_variant(try_variant_get(r, '{path}', 'variant')) = '{kind}' " \
               f"THEN try_variant_get(r, '{path}', '{'string' if kind == 'STRING' else 'int'}') END AS {out}"

    items = reports.select(F.expr(
        "explode(try_variant_get(try_parse_json(payload), '$.results', 'array<variant>')) AS r"
    )).filter(
        "schema_of_variant(r) LIKE 'OBJECT%' "
        "AND schema_of_variant(try_variant_get(r, '$.extra', 'variant')) LIKE 'OBJECT%'"
    )
    fields = items.select(
        F.expr(typed("$.check_id", "STRING", "raw_id")), F.expr(typed("$.path", "STRING", "file")),
        F.expr(typed("$.start.line", "BIGINT", "line_start")), F.expr(typed("$.end.line", "BIGINT", "line_end")),
        F.expr(typed("$.extra.lines", "STRING", "lines")), F.expr(typed("$.extra.severity", "STRING", "raw_severity")),
        F.expr(typed("$.extra.message", "STRING", "raw_message")),
        F.expr("schema_of_variant(try_variant_get(r, '$.extra.message', 'variant')) IS NULL AS no_message"),
    ).filter("raw_id IS NOT NULL AND file IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL")
    rule_id = normalise_rule_id(F.col("raw_id"))
    message = F.when(F.col("no_message"), F.lit("")).otherwise(F.coalesce("raw_message", rule_id))
    return fields.select(
        rule_id.alias("rule_id"), "file", "line_start", "line_end",
        sev.from_tool(F.coalesce("raw_severity", F.lit("WARNING"))).alias("severity"),
        F.trim(message).alias("message"), F.trim(F.coalesce("lines", F.lit(""))).alias("evidence"),
    )
