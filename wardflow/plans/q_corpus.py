"""Registered queries: sources, text rules, call sites and corpus rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..dims import SECRET_PATTERNS
from ..functions import severity as sev
from ..functions import text as tx
from ..operators import callsites as cs
from ..operators import integrity as ig
from ..operators import pattern_rules as pr
from ..operators import rules as rl
from ..sources import baseline as bl
from ..sources import files as fs
from ..sources import notebooks as nb
from ..sources import requirements as rq
from ..sources import tool_json as tj
from . import audit as au
from . import standins as st
from .registry import query
from .standins import sql


# --- S2-S10: sources ------------------------------------------------------------------------------

@query("S2_source_files", sql("fxp", """
  SELECT path, CASE WHEN suffix(path, '.ipynb') THEN 'notebook' ELSE 'python' END AS kind FROM fxp WHERE suffix(path, '.ipynb') OR suffix(path, '.py')"""))
def _s2(spark, sf):
    kind = fs.file_kind(F.col("path"))
    return st.order_paths(spark, sf, "fixture").select("path", kind.alias("kind")).filter(F.col("kind").isin("notebook", "python"))


@query("S2_scan_files", sql("py", "SELECT path, md5(content) AS digest FROM py"))
def _s2scan(spark, sf):
    """Every Python source, written as a line of its path and digest into text files, which the file scan reads back."""
    folder = st.scratch(spark, "files")
    sources = st.python_files(spark, sf).select(F.concat_ws(" ", "path", F.md5(F.col("content").cast("binary"))).alias("value"))
    sources.write.text(folder)
    lines = fs.as_text(fs.read_files(spark, folder, ("*.txt",))).select(F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.split("line", " ")[0].alias("path"), F.split("line", " ")[1].alias("digest"))


@query("S3_install_inputs", """
  SELECT path, kind FROM (SELECT 'p' || p_partkey || '/requirements.txt' AS path, 'requirements' AS kind FROM part
    UNION ALL SELECT 'nb/' || event_id || '.ipynb', 'notebook' FROM events)""")
def _s3(spark, sf):
    paths = st.requirement_files(spark, sf).select("path").unionByName(st.notebooks(spark, sf).select("path"))
    return paths.select("path", fs.file_kind(F.col("path")).alias("kind")).filter(F.col("kind").isin("requirements", "notebook"))


@query("S4_model_files", sql("mdp", """
  SELECT path FROM mdp WHERE (suffix(path, '.h5') OR suffix(path, '.keras')) AND NOT contains(path, '/.venv/') AND NOT contains(path, '/node_modules/')"""))
def _s4(spark, sf):
    return st.order_paths(spark, sf, "model").filter(fs.is_model_file(F.col("path")))


@query("S5_unreadable", sql("ev nb", """
  SELECT 'nb/' || id || '.ipynb' AS path, 'not JSON' AS reason FROM ev WHERE id % 97 = 0
  UNION ALL SELECT path, 'source does not parse' FROM nb WHERE id % 89 = 0"""))
def _s5_unreadable(spark, sf):
    from ..operators.unreadable import unreadable

    return unreadable(st.notebooks(spark, sf))


@query("S5_code_cells", sql("nbc", "SELECT path, code_idx, cell_idx, md5(source) AS source FROM nbc"))
def _s5(spark, sf):
    return nb.explode_code_cells(st.notebooks(spark, sf)).select("path", "code_idx", "cell_idx", F.md5(F.col("source").cast("binary")).alias("source"))


@query("S6_requirement_lines", sql("rq", """
  SELECT path, CAST(n AS INT) AS line_no, l AS raw FROM (SELECT path, unnest(string_split(rtrim(content, chr(10)), chr(10))) AS l,
    generate_subscripts(string_split(rtrim(content, chr(10)), chr(10)), 1) AS n FROM rq)"""))
def _s6(spark, sf):
    return rq.explode_lines(st.requirement_files(spark, sf))


@query("S7_advisories", """
  SELECT 'c' || c_custkey || '/requirements.txt' AS file, 'lib' || (c_custkey % 9) AS name, CAST(c_nationkey AS VARCHAR) AS version, 'V-' || c_custkey AS vuln_id,
    '1,2' AS fix_versions, c_mktsegment AS description FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT 'c' || c_custkey || '/requirements.txt', '<unknown>', '<unknown>', 'UNKNOWN', '', 'see advisory for details.' FROM customer WHERE c_custkey % 10 <> 0""")
def _s7(spark, sf):
    return tj.read_advisories(st.advisory_reports(spark, sf)).withColumn("fix_versions", F.array_join("fix_versions", ","))


_PATTERN_SQL = """
  SELECT 'ml-hygiene.r' || (o_orderkey % 5) AS rule_id, 'f' || o_custkey || '.py' AS file, CAST(o_orderkey % 50 + 1 AS INT) AS line_start,
    CAST(o_orderkey % 50 + 2 AS INT) AS line_end, CASE o_orderkey % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'medium' END AS severity,
    'm' || o_orderkey AS message, 'x = 1' AS evidence FROM orders WHERE o_orderkey % 10 <> 0"""


@query("S8_pattern_results", _PATTERN_SQL)
def _s8(spark, sf):
    return tj.read_pattern_results(st.pattern_reports(spark, sf))


@query("S9_baseline_ids", """
  SELECT 'f' || p_partkey AS file, r AS rule_id FROM part, (VALUES ('a'), ('a')) t(r) UNION ALL SELECT 'f' || p_partkey, 'b' || (p_size % 3) FROM part""")
def _s9(spark, sf):
    return bl.expected_ids(bl.parse_baseline(st.baseline_documents(spark, sf)))


@query("S10_fixture_checks", sql("fxp", """
  SELECT path, substr(path, 10) AS file, split_part(path, '/', 4) AS "check" FROM fxp
  WHERE (suffix(path, '.ipynb') OR suffix(path, '.py')) AND split_part(path, '/', 4) IN ('leakage', 'deserialization', 'secrets', 'supply_chain', 'adversarial')"""))
def _s10(spark, sf):
    return fs.with_fixture_check(st.order_paths(spark, sf, "fixture"), "/data/fx").select("path", "file", "check")


# Files of a project per supplier, written into nested folders; hidden, dependency and unrelated ones among them.
def _below(path):
    return F.regexp_extract(path, "/projects/(.*)$", 1)


@query("S2_scan_folder", sql("prj", "SELECT path, md5(content) AS digest FROM prj WHERE suffix(path, '.py') OR suffix(path, '.ipynb')"))
def _s2_folder(spark, sf):
    return fs.read_sources(spark, st.projects(spark, sf)).select(_below("path").alias("path"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("S3_scan_folder", sql("prj", "SELECT path, md5(content) AS digest FROM prj WHERE suffix(path, '.ipynb') OR regexp_full_match(path, '.*/requirements[^/]*[.]txt')"))
def _s3_folder(spark, sf):
    return fs.read_install_inputs(spark, st.projects(spark, sf)).select(_below("path").alias("path"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("S4_scan_folder", sql("prj", "SELECT path FROM prj WHERE regexp_full_match(path, '.*/models/net[.](h5|keras)')"))
def _s4_folder(spark, sf):
    return fs.find_model_files(spark, st.projects(spark, sf)).select(_below("path").alias("path"))


@query("S10_scan_folder", sql("prj", """
  SELECT path AS file, split_part(path, '/', 1) AS "check" FROM prj WHERE (suffix(path, '.py') OR suffix(path, '.ipynb')) AND split_part(path, '/', 1) <> 'docs'"""))
def _s10_folder(spark, sf):
    root = st.projects(spark, sf)
    return fs.with_fixture_check(fs.list_files(spark, root).select("path"), fs.whole_path(root)).select("file", "check")


@query("K9_manifest", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def _k9(spark, sf):
    return ig.manifest(_artifacts(spark, sf))


def _artifacts(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))


@query("K9_verify", """
  SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'unlisted' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'ok' END AS state FROM documents""")
def _k9v(spark, sf):
    files = _artifacts(spark, sf)
    changed = files.withColumn("content", F.when(F.col("doc_id") % 10 == 2, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return ig.verify(ig.manifest(files.filter("doc_id % 10 <> 1")), ig.manifest(changed.filter("doc_id % 10 <> 0")))


@query("K9_streamed", """
  SELECT doc_id % 64 AS part, sha256(string_agg(sha256(coalesce(text, '')) || chr(10), '' ORDER BY doc_id)) AS sha256, CAST(65 * count(*) AS BIGINT) AS size
  FROM documents GROUP BY 1""")
def _k9s(spark, sf):
    """All documents' digests written as lines of files in folders, then listed and hashed as files."""
    path = st.scratch(spark, "digests")
    lines = st.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 64).alias("part"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("line"))
    lines.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "line").write.partitionBy("part").text(path)
    files = ig.manifest_of(spark, path, "*.txt")
    return files.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint").alias("part"), "sha256", "size")


# --- C1-C8, C24, P14, W2, W3: lines and names -----------------------------------------------------

@query("C1_line_of_match", """
  SELECT doc_id, CAST(len(string_split(left(text, CAST(instr(text, 'token =') - 1 AS BIGINT)), chr(10))) AS INT) AS line_no FROM documents WHERE contains(text, 'token =')""")
def _c1(spark, sf):
    at = F.instr("text", "token =")
    return st.table(spark, sf, "documents").filter(at > 0).select("doc_id", tx.line_of(F.col("text"), at - 1).alias("line_no"))


@query("C2_blank_magic", sql("nbc", r"SELECT path, code_idx, md5(regexp_replace(source, '(?m)^[ \t]*[%!][^\n]*', '', 'g')) AS source FROM nbc"))
def _c2(spark, sf):
    cells = nb.explode_code_cells(st.notebooks(spark, sf))
    return cells.select("path", "code_idx", F.md5(tx.blank_magic(F.col("source")).cast("binary")).alias("source"))


_INSTALL_LINES = r"""
  l AS (SELECT path, cell_idx, source, unnest(string_split(source, chr(10))) AS line, generate_subscripts(string_split(source, chr(10)), 1) AS line_no FROM nbc),
  p AS (SELECT *, regexp_extract(line, '^[ \t]*[!%]pip(?:[ \t]+(?:install|--quiet|-q))+[ \t]+(.+?)[ \t]*$', 1) AS rest FROM l),
  w AS (SELECT *, regexp_split_to_array(rest, '\s+') AS tokens FROM p WHERE rest <> ''),
  s AS (SELECT path, cell_idx, line, line_no, unnest(list_filter(tokens[1:CASE WHEN list_position(list_transform(tokens, lambda t: starts_with(t, '#')), true) > 0
          THEN list_position(list_transform(tokens, lambda t: starts_with(t, '#')), true) - 1 ELSE len(tokens) END],
          lambda t: t <> '' AND NOT regexp_matches(t, '^--?[A-Za-z][\w-]*(=\S+)?$'))) AS spec FROM w)
"""


@query("C3_package_specs", sql("nbc", f"WITH {_INSTALL_LINES} SELECT path, CAST(line_no AS INT) AS line_no, spec FROM s"))
def _c3(spark, sf):
    lines = rl.install_lines(st.notebooks(spark, sf)).filter(F.col("line").rlike(tx.PIP_LINE))
    return lines.select("path", "line_no", F.explode(tx.package_specs(F.regexp_extract("line", tx.PIP_LINE, 1))).alias("spec"))


@query("C4_pinned", sql("rq", r"""
  SELECT path, l AS line, regexp_matches(l, '==|~=|>|<|@|git\+|https?://') AS pinned
  FROM (SELECT path, trim(unnest(string_split(content, chr(10)))) AS l FROM rq) WHERE l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, '-')"""))
def _c4(spark, sf):
    return rq.requirement_lines(st.requirement_files(spark, sf)).select("path", "line", tx.is_pinned(F.col("line")).alias("pinned"))


@query("P14_requirement_filter", sql("rq", """
  SELECT path, CAST(n AS INT) AS line_no FROM (SELECT path, trim(unnest(string_split(content, chr(10)))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM rq)
  WHERE l <> '' AND l[1] NOT IN ('#', '-')"""))
def _p14(spark, sf):
    return rq.requirement_lines(st.requirement_files(spark, sf)).select("path", "line_no")


# Column names to judge, from the words of part names and types.
_NAMES = """SELECT p_partkey AS id, CASE p_partkey % 16 WHEN 0 THEN 'difficulty' WHEN 1 THEN 'Difficulty_Level' WHEN 2 THEN p_brand || '_label' WHEN 3 THEN p_type || '_TARGET'
  WHEN 4 THEN 'target_' || p_size WHEN 5 THEN 'label_' || p_size WHEN 6 THEN 'outcome' WHEN 7 THEN 'outcomes' WHEN 8 THEN 'class_id' WHEN 9 THEN 'is_card_fraud'
  WHEN 10 THEN 'data_leak' WHEN 11 THEN 'leak_' || p_size WHEN 12 THEN 'cheat_x' WHEN 13 THEN 'src_bytes' WHEN 14 THEN 'x_test' ELSE 'X_test_' || p_size END AS name FROM {t}"""


def _names(spark, sf):
    return spark.sql(_NAMES.format(t="{t}"), t=st.table(spark, sf, "part"))


@query("C5_label_proxy_names", f"WITH n AS ({_NAMES.format(t='part')})" + r"""
  SELECT id, name, regexp_matches(lower(name), '^(difficulty(_level)?|.+_label|.+_target|outcome|result_class|class_id|is_.+_fraud|.+_leak)$|^(target|label|leak|cheat)_.') AS proxy FROM n""")
def _c5(spark, sf):
    return _names(spark, sf).select("id", "name", tx.is_label_proxy(F.col("name")).alias("proxy"))


@query("C6_test_names", f"WITH n AS ({_NAMES.format(t='part')})" + r"""
  SELECT id, regexp_matches(lower(name), '^(x_?test|_?test_?[xy]|test_features|test_data)$') AS exact, regexp_matches(name, '^(X_?test|test_?[XY])') AS prefix FROM n""")
def _c6(spark, sf):
    return _names(spark, sf).select("id", tx.is_test_name(F.col("name")).alias("exact"), tx.has_test_prefix(F.col("name")).alias("prefix"))


@query("C7_normalise_rule_id", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'other.r' ELSE 'ml-hygiene.r' || (o_orderkey % 5) END AS rule_id FROM orders""")
def _c7(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("other.r")).otherwise(F.concat(F.lit("src.rules.ml-hygiene.r"), (F.col("o_orderkey") % 5).cast("string")))
    return st.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), tx.normalise_rule_id(raw).alias("rule_id"))


@query("C8_tool_severity", """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'info' ELSE 'medium' END AS severity FROM orders""")
def _c8(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", "ERROR").when(F.col("o_orderstatus") == "O", "INFO").otherwise(F.col("o_orderstatus"))
    return st.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), sev.from_tool(raw).alias("severity"))


@query("C24_checksum_hint", sql("nbc", """SELECT path, bool_or(regexp_matches(source, 'sha256|sha512|md5sum|shasum|hashlib')) AS verified FROM nbc GROUP BY 1"""))
def _c24(spark, sf):
    read = st.notebooks(spark, sf).select("path", nb.code_cells("content").alias("code"))
    return read.filter(F.size("code") > 0).select("path", rl.verifies_downloads(F.col("code")).alias("verified"))


@query("W2_cell_starts", sql("nbc", """
  SELECT path, code_idx, CAST(1 + coalesce(sum(len(string_split(source, chr(10)))) OVER (PARTITION BY path ORDER BY code_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS starts FROM nbc"""))
def _w2(spark, sf):
    starts = nb.with_module(st.notebooks(spark, sf)).select("path", F.posexplode(F.slice("cell_starts", F.lit(1), F.size("code"))).alias("code_idx", "starts"))
    return starts


@query("W2_turn_offsets", """
  SELECT conv_id, turn, CAST(coalesce(sum(len(string_split(text, chr(10))) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS starts
  FROM conversations WHERE role = 'assistant'""")
def _w2t(spark, sf):
    """Cells already in a table: a two-level running total, so a conversation of any length is spread."""
    from ..functions.ordering import running_total

    turns = st.table(spark, sf, "conversations").filter("role = 'assistant'")
    total = running_total(turns, "conv_id", "turn", nb.newline_count(F.col("text")) + 2, "before", chunk=4)
    return total.select("conv_id", "turn", (F.col("before") + 1).alias("starts"))


@query("W3_cell_of_line", sql("nbc", """
  SELECT path, CAST(joined AS INT) AS line_no, code_idx, CAST(n AS INT) AS line_in_cell, CAST(joined + code_idx AS INT) AS marked FROM (
    SELECT path, code_idx, n, row_number() OVER (PARTITION BY path ORDER BY code_idx, n) AS joined
    FROM (SELECT path, code_idx, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS n FROM nbc))"""))
def _w3(spark, sf):
    lines = nb.with_module(st.notebooks(spark, sf)).select("path", "cell_starts", F.explode(F.sequence(F.lit(1), F.element_at("cell_starts", -1) - 1)).alias("line_no"))
    at, starts = F.col("line_no"), F.col("cell_starts")
    return lines.select("path", "line_no", nb.code_cell_of(at, starts).alias("code_idx"), nb.line_in_cell(at, starts).alias("line_in_cell"), nb.marked_line(at, starts).alias("marked"))


# --- R0, C16, C25: call sites ---------------------------------------------------------------------

@query("R0_call_sites", sql("nbok", """
  SELECT path, 10 AS line, CASE et WHEN 'click' THEN 'joblib.load' WHEN 'view' THEN 'pickle.load' WHEN 'purchase' THEN 'torch.load' WHEN 'signup' THEN 'numpy.load' END AS what FROM nbok WHERE et <> 'error'
  UNION ALL SELECT path, 11, 'strings:' || CASE WHEN k % 6 < 3 THEN 3 ELSE 2 END FROM nbok
  UNION ALL SELECT path, 12, 'drop:' || CASE WHEN k % 6 = 1 THEN 'difficulty_level' ELSE '' END FROM nbok WHERE k % 6 IN (1, 2)
  UNION ALL SELECT path, 13, 'fit:literal' FROM nbok UNION ALL SELECT path, 14, 'fit_resample:X' FROM nbok WHERE k % 8 < 3
  UNION ALL SELECT path, 16, 'split' FROM nbok WHERE k % 8 <> 2
  UNION ALL SELECT path, 17, 'fit:' || CASE WHEN k % 10 = 0 THEN 'X_test' ELSE 'X_train' END FROM nbok
  UNION ALL SELECT path, 18, 'strings:1' FROM nbok WHERE k % 11 = 0"""))
def _r0(spark, sf):
    f = F.col("f")
    what = (
        F.when(f["kind"] != "call", F.concat(F.lit("strings:"), F.size(f["strings"]).cast("string")))
        .when(f["bare_name"] == cs.SPLIT, "split").when(f["attr"] == "drop", F.concat(F.lit("drop:"), F.array_join(f["strings"], ",")))
        .when(f["attr"].isin(*cs.FIT_METHODS), F.concat(f["attr"], F.lit(":"), F.when(f["first_arg_is_literal"], "literal").otherwise(f["first_arg_name"])))
        .otherwise(f["qualified_name"])
    )
    return rl.fact_rows(rl.notebook_facts(st.notebooks(spark, sf))).select("path", f["line_start"].alias("line"), what.alias("what"))


@query("C16_split_alias", sql("nbok", "SELECT path, 16 AS line FROM nbok WHERE k % 8 = 1"))
def _c16(spark, sf):
    rows = rl.fact_rows(rl.notebook_facts(st.notebooks(spark, sf)))
    return rows.filter((F.col("f.bare_name") == cs.SPLIT) & F.col("f.evidence").startswith("tts(")).select("path", F.col("f.line_start").alias("line"))


@query("C25_string_literals", sql("nbok", """
  SELECT path, unnest(list_concat(CASE WHEN k % 6 < 3 THEN ['duration', 'difficulty_level', 'src_bytes'] ELSE ['duration', 'src_bytes'] END,
                                  CASE WHEN k % 11 = 0 THEN ['ghp_' || md5(CAST(id AS VARCHAR)) || 'abcd'] ELSE [] END)) AS name FROM nbok"""))
def _c25(spark, sf):
    rows = rl.fact_rows(rl.notebook_facts(st.notebooks(spark, sf)))
    return rows.filter("f.kind <> 'call'").select("path", F.explode("f.strings").alias("name"))


# --- R1-R16, J5, J6: rules ------------------------------------------------------------------------

def _rule(findings, rule, *columns):
    return findings.filter(F.col("rule_id") == rule).select(*columns)


@query("R1_unpinned_install", sql("nbc", rf"""WITH {_INSTALL_LINES}
  SELECT path AS file, CAST(line_no AS INT) AS line_start, trim(line) AS evidence, '`' || spec || '` is installed without a version (cell ' || cell_idx || ')' AS message
  FROM s WHERE NOT regexp_matches(spec, '==|~=|>|<|@|git\+|https?://')"""))
def _r1(spark, sf):
    return _rule(rl.notebook_supply_chain(st.notebooks(spark, sf)), "supply_chain.unpinned-pip-install", "file", "line_start", "evidence", "message")


@query("R2_untrusted_download", sql("nb", """
  SELECT path AS file, 3 AS line_start, '!wget https://data.example.org/' || id || '.csv' AS evidence, '`wget` downloads a file that no cell verifies (cell 1)' AS message
  FROM nb WHERE k % 3 = 0 AND k % 4 <> 0"""))
def _r2(spark, sf):
    return _rule(rl.notebook_supply_chain(st.notebooks(spark, sf)), "supply_chain.untrusted-wget-source", "file", "line_start", "evidence", "message")


@query("R3_unpinned_requirement", """
  SELECT 'p' || p_partkey || '/requirements.txt' AS file, 2 AS line_start, replace(p_name, ' ', '-') AS evidence,
    '`' || replace(p_name, ' ', '-') || '` in requirements.txt has no version' AS message FROM part WHERE p_size % 2 = 1
  UNION ALL SELECT 'p' || p_partkey || '/requirements.txt', 5, '  lib' || p_size || ' ', '`lib' || p_size || '` in requirements.txt has no version' FROM part""")
def _r3(spark, sf):
    return rl.requirement_findings(st.requirement_files(spark, sf)).select("file", "line_start", "evidence", "message")


@query("R4_known_cve", """
  SELECT 'c' || c_custkey || '/requirements.txt' AS file, CAST(NULL AS INT) AS line_start, '`' || n || '` is affected by ' || v || ': ' || d AS message, n || ' -> ' || v AS evidence,
    'Upgrade `' || split_part(n, '==', 1) || '` to ' || f || '.' AS fix
  FROM (SELECT c_custkey, 'lib' || (c_custkey % 9) || '==' || c_nationkey AS n, 'V-' || c_custkey AS v, c_mktsegment AS d, '1, 2' AS f FROM customer
        UNION ALL SELECT c_custkey, '<unknown>==<unknown>', 'UNKNOWN', 'see advisory for details.', 'a patched release' FROM customer) WHERE c_custkey % 10 <> 0""")
def _r4(spark, sf):
    return rl.advisory_findings(st.advisory_reports(spark, sf)).select("file", "line_start", "message", "evidence", F.col("fix.summary").alias("fix"))


def _loader(rule, where, evidence):
    return sql("nbok", f"SELECT path AS file, 10 AS line_start, {evidence} AS evidence FROM nbok WHERE {where}")


def _notebook_rule(spark, sf, rule, *columns):
    return _rule(rl.call_site_findings(rl.notebook_facts(st.notebooks(spark, sf)), only=[rule]), rule, *columns)


def _loads(spark, sf, rule):
    return _notebook_rule(spark, sf, rule, "file", "line_start", "evidence")


@query("R5_unsafe_joblib", _loader("", "et = 'click'", st._quoted("joblib.load(~m.pkl~)")))
def _r5(spark, sf):
    return _loads(spark, sf, "deserialization.unsafe-joblib-load")


@query("R6_unsafe_pickle", _loader("", "et = 'view'", st._quoted("pk.load(open(~m.pkl~, ~rb~))")))
def _r6(spark, sf):
    return _loads(spark, sf, "deserialization.unsafe-pickle-load")


@query("R7_unsafe_torch", _loader("", "et = 'purchase' AND k % 2 = 0", st._quoted("torch.load(~m.pt~)")))
def _r7(spark, sf):
    return _loads(spark, sf, "deserialization.unsafe-torch-load")


@query("R8_unsafe_numpy", _loader("", "et = 'signup' AND k % 2 = 0", st._quoted("np.load(~m.npy~, allow_pickle=True)")))
def _r8(spark, sf):
    return _loads(spark, sf, "deserialization.unsafe-numpy-load")


_R9 = """SELECT path AS file, 2 AS line_start, '[cell 3] fitted on the full data (line 17) before the split (line 19)' AS message FROM nbok WHERE k % 8 IN (0, 1)"""


@query("R9_fit_before_split", sql("nbok", _R9))
def _r9(spark, sf):
    return _notebook_rule(spark, sf, "leakage.preprocessing-before-split", "file", "line_start", "message")


@query("J6_fit_line_before_split", sql("nbok", "SELECT path, 14 AS fit_line, 16 AS split_line FROM nbok WHERE k % 8 IN (0, 1)"))
def _j6(spark, sf):
    rows = rl.fact_rows(rl.notebook_facts(st.notebooks(spark, sf)))
    fits = F.col("f.attr").isin(*cs.FIT_METHODS) & ~F.col("f.first_arg_is_literal") & (F.col("f.line_start") < F.col("split_line"))
    return rows.filter(fits).select("path", F.col("f.line_start").alias("fit_line"), "split_line")


@query("R10_fit_on_test", sql("nbok", "SELECT path AS file, 5 AS line_start, '[cell 3] `fit(X_test, ...)` is fitted on test data' AS message FROM nbok WHERE k % 10 = 0"))
def _r10(spark, sf):
    return _notebook_rule(spark, sf, "leakage.fit-on-test", "file", "line_start", "message")


@query("R11_label_proxy", sql("nbok", """
  SELECT path AS file, 1 AS line_start, '[cell 2] column `difficulty_level` in an assignment looks like a proxy of the label' AS message FROM nbok WHERE k % 6 IN (0, 2)"""))
def _r11(spark, sf):
    return _notebook_rule(spark, sf, "leakage.label-proxy-feature", "file", "line_start", "message")


@query("J5_proxies_not_dropped", sql("nbok", "SELECT path, 'difficulty_level' AS name FROM nbok WHERE k % 6 IN (0, 2)"))
def _j5(spark, sf):
    rows = rl.fact_rows(rl.notebook_facts(st.notebooks(spark, sf))).filter("f.kind <> 'call'")
    named = rows.select("path", "dropped", F.explode("f.strings").alias("name"))
    return named.filter(tx.is_label_proxy(F.col("name")) & ~F.array_contains("dropped", F.col("name"))).select("path", "name")


def _python_rule(spark, sf, rule, *columns):
    return _rule(rl.call_site_findings(rl.python_facts(st.python_files(spark, sf)), only=[rule]), rule, *columns)


@query("R10_fit_on_test_python", sql("py", "SELECT path AS file, 3 AS line_start FROM py WHERE o_custkey % 5 IN (0, 2, 4)"))
def _r10p(spark, sf):
    return _python_rule(spark, sf, "leakage.fit-on-test", "file", "line_start")


@query("R11_label_proxy_python", sql("py", "SELECT path AS file, 4 AS line_start FROM py WHERE o_orderkey % 3 = 0"))
def _r11p(spark, sf):
    return _python_rule(spark, sf, "leakage.label-proxy-feature", "file", "line_start")


@query("R12_fit_on_test_arg", sql("py", "SELECT path AS file, 3 AS line_start, '`fit(X_test, ...)` is fitted on a test variable' AS message FROM py WHERE o_custkey % 5 = 0"))
def _r12(spark, sf):
    return _python_rule(spark, sf, "ml-hygiene.fit-on-test-arg", "file", "line_start", "message")


@query("R13_fit_transform_on_test_arg", sql("py", "SELECT path AS file, 3 AS line_start FROM py WHERE o_custkey % 5 = 1"))
def _r13(spark, sf):
    return _python_rule(spark, sf, "ml-hygiene.fit-transform-on-test-arg", "file", "line_start")


@query("R14_split_without_shuffle", sql("py", "SELECT path AS file, 2 AS line_start, 'train_test_split(X, shuffle=False)' AS evidence FROM py WHERE o_orderkey % 4 = 0"))
def _r14(spark, sf):
    return _python_rule(spark, sf, "ml-hygiene.train-test-split-with-shuffle-false", "file", "line_start", "evidence")


_SECRET_SQL = " UNION ALL ".join(
    f"SELECT path, '{rule}' AS rule_id, line_no, unnest(regexp_extract_all(line, '{pattern}')) AS token FROM l" for rule, pattern in SECRET_PATTERNS)
_SECRET_LINES = "l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs)"


@query("R15_secrets_in_text", sql("docs", f"""
  WITH {_SECRET_LINES}, t AS ({_SECRET_SQL}) SELECT path AS file, rule_id, CAST(line_no AS INT) AS line_start, left(token, 8) || '...(' || length(token) || ')' AS evidence FROM t"""))
def _r15(spark, sf):
    return rl.secret_findings(st.planted_documents(spark, sf)).select("file", "rule_id", "line_start", "evidence")


@query("R15_secrets_in_pages", sql("pgs", f"""
  WITH l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM pgs),
  t AS ({_SECRET_SQL}) SELECT path, rule_id, CAST(line_no AS INT) AS line_start, token FROM t"""))
def _r15p(spark, sf):
    return rl.secret_lines(st.planted_pages(spark, sf)).select("path", "rule_id", "line_start", "token")


@query("R16_secrets_in_outputs", sql("nb", """
  SELECT path AS file, 'secrets.leaked-in-notebook-output' AS rule_id, CAST(NULL AS INT) AS line_start, 'a credential is left in a saved output (cell 5)' AS message FROM nb WHERE k % 13 = 0
  UNION ALL SELECT path, 'secrets.github-token', 6, 'a credential is written into the source (cell 5)' FROM nb WHERE k % 11 = 0"""))
def _r16(spark, sf):
    return rl.notebook_secret_findings(st.notebooks(spark, sf)).select("file", "rule_id", "line_start", "message")


@query("U2_pattern_findings", f"""SELECT rule_id, 'leakage' AS "check", severity, file, line_start, message FROM ({_PATTERN_SQL})""")
def _u2(spark, sf):
    return rl.pattern_findings(st.pattern_reports(spark, sf)).select("rule_id", "check", "severity", "file", "line_start", "message")


# Rules of a user, as they would stand in a file: the three that the library ships, and others of every kind of clause.
_OWN_RULES = [
    {"id": "own.split", "severity": "INFO", "kinds": ["python", "notebook"], "message": "`$X` is split", "pattern": "train_test_split($X, ...)"},
    {"id": "own.loader", "severity": "ERROR", "kinds": ["notebook"], "message": "loads $FILE", "pattern-either": ["pickle.load($FILE)", "joblib.load($FILE)"]},
    {"id": "own.pair", "severity": "WARNING", "message": "$OBJ takes $A and $B", "patterns": [{"pattern": "$OBJ.fit_transform($A, $B)"}]},
    {"id": "own.label-argument", "severity": "WARNING", "message": "$OBJ.$HOW", "patterns": [
        {"pattern": "$OBJ.$HOW(..., y, ...)"}, {"metavariable-regex": {"metavariable": "$HOW", "regex": "fit$"}}, {"pattern-not": "$OBJ.fit(X, ...)"}]},
    {"id": "own.broken", "severity": "ERROR", "message": "", "pattern": "$X = load()"},
]


def _own_rules(spark):
    with open(pr.SHIPPED, encoding="utf-8") as text:
        document = {"rules": [*json.load(text)["rules"], *_OWN_RULES]}
    folder = st.scratch(spark, "rules")
    spark.createDataFrame([(json.dumps(document),)], "value string").write.text(folder)
    return pr.read_rules(spark, folder)


@query("U2_declared_rules", sql("nbok py", """
  SELECT path AS file, 'ml-hygiene.fit-on-test-arg' AS rule_id, 'high' AS severity, 3 AS line_start, '`fit(X_test, ...)` is fitted on a test variable' AS message FROM py WHERE o_custkey % 5 = 0
  UNION ALL SELECT path, 'ml-hygiene.fit-transform-on-test-arg', 'high', 3, '`fit_transform(X_test_scaled, ...)` is fitted on a test variable' FROM py WHERE o_custkey % 5 = 1
  UNION ALL SELECT path, 'ml-hygiene.train-test-split-with-shuffle-false', 'medium', 2, 'the split neither shuffles nor stratifies' FROM py WHERE o_orderkey % 4 = 0
  UNION ALL SELECT path, 'own.split', 'low', 2, '`X` is split' FROM py WHERE o_orderkey % 4 < 3
  UNION ALL SELECT path, 'own.split', 'low', 4, '`X` is split' FROM nbok WHERE k % 8 <> 2
  UNION ALL SELECT path, 'own.loader', 'high', 6, replace('loads ' || CASE et WHEN 'click' THEN '~m.pkl~' ELSE 'open(~m.pkl~, ~rb~)' END, '~', chr(39)) FROM nbok WHERE et IN ('click', 'view')
  UNION ALL SELECT path, 'own.pair', 'medium', 3, 's takes X_test_scaled and y' FROM py WHERE o_custkey % 5 = 1
  UNION ALL SELECT path, 'own.label-argument', 'medium', 3, 's.fit' FROM py WHERE o_custkey % 5 = 4"""))
def _u2_declared(spark, sf):
    rules, _ = _own_rules(spark)
    files = st.notebooks(spark, sf).unionByName(st.python_files(spark, sf)).withColumn("source_kind", fs.file_kind(F.col("path")))
    found = rl.declared_findings(files, rules)
    return found.select("file", "rule_id", "severity", "line_start", F.regexp_replace("message", r"^\[cell \d+\] ", "").alias("message"))


# --- U1, L1: whole audits -------------------------------------------------------------------------

_AUDIT = """
  SELECT path AS file, 'supply_chain.unpinned-pip-install' AS rule_id, 1 AS line_start FROM nb WHERE k % 2 = 1
  UNION ALL SELECT path, 'supply_chain.unpinned-pip-install', 2 FROM nb WHERE k % 5 = 0
  UNION ALL SELECT path, 'supply_chain.untrusted-wget-source', 3 FROM nb WHERE k % 3 = 0 AND k % 4 <> 0
  UNION ALL SELECT path, 'deserialization.unsafe-' || CASE et WHEN 'click' THEN 'joblib' WHEN 'view' THEN 'pickle' WHEN 'purchase' THEN 'torch' ELSE 'numpy' END || '-load', 10
    FROM nbok WHERE et IN ('click', 'view') OR (et IN ('purchase', 'signup') AND k % 2 = 0)
  UNION ALL SELECT path, 'leakage.preprocessing-before-split', 2 FROM nbok WHERE k % 8 IN (0, 1)
  UNION ALL SELECT path, 'leakage.fit-on-test', 5 FROM nbok WHERE k % 10 = 0
  UNION ALL SELECT path, 'leakage.label-proxy-feature', 1 FROM nbok WHERE k % 6 IN (0, 2)
  UNION ALL SELECT path, 'secrets.leaked-in-notebook-output', NULL FROM nb WHERE k % 13 = 0
  UNION ALL SELECT path, 'secrets.github-token', 6 FROM nb WHERE k % 11 = 0
  UNION ALL SELECT path, 'leakage.fit-on-test', 3 FROM py WHERE o_custkey % 5 IN (0, 2, 4)
  UNION ALL SELECT path, 'leakage.label-proxy-feature', 4 FROM py WHERE o_orderkey % 3 = 0
  UNION ALL SELECT path, 'ml-hygiene.fit-on-test-arg', 3 FROM py WHERE o_custkey % 5 = 0
  UNION ALL SELECT path, 'ml-hygiene.fit-transform-on-test-arg', 3 FROM py WHERE o_custkey % 5 = 1
  UNION ALL SELECT path, 'ml-hygiene.train-test-split-with-shuffle-false', 2 FROM py WHERE o_orderkey % 4 = 0
  UNION ALL SELECT 'p' || p_partkey || '/requirements.txt', 'supply_chain.unpinned-requirement', 2 FROM part WHERE p_size % 2 = 1
  UNION ALL SELECT 'p' || p_partkey || '/requirements.txt', 'supply_chain.unpinned-requirement', 5 FROM part
"""


def _corpus(spark, sf):
    return st.notebooks(spark, sf).unionByName(st.python_files(spark, sf)).unionByName(st.requirement_files(spark, sf))


@query("L1_audit", sql("nb nbok py", f"WITH a AS ({_AUDIT}) SELECT file, rule_id, line_start FROM a"))
def _l1(spark, sf):
    return au.audit_findings(_corpus(spark, sf), "run").select("file", "rule_id", "line_start")


@query("U1_check_registry", sql("nb nbok py", f"""
  WITH a AS ({_AUDIT}) SELECT CASE WHEN starts_with(rule_id, 'ml-hygiene') THEN 'leakage' ELSE split_part(rule_id, '.', 1) END AS "check", rule_id, count(*) AS findings FROM a GROUP BY 1, 2"""))
def _u1(spark, sf):
    found = au.run_checks(_corpus(spark, sf))
    return found.groupBy("check", "rule_id").agg(F.count("*").alias("findings"))


@query("L4_evaluate", sql("nb nbok py", f"""
  WITH a AS ({_AUDIT}), f AS (SELECT file, rule_id, count(*) AS got FROM a WHERE starts_with(rule_id, 'leakage') OR starts_with(rule_id, 'ml-hygiene') GROUP BY 1, 2),
  e AS (SELECT path AS file, 'leakage.label-proxy-feature' AS rule_id, 1 AS want FROM nb WHERE k % 6 < 3 UNION ALL SELECT path, 'leakage.fit-on-test', 1 FROM py WHERE o_custkey % 5 < 3),
  m AS (SELECT least(coalesce(got, 0), coalesce(want, 0)) AS tp, greatest(coalesce(got, 0) - coalesce(want, 0), 0) AS fp, greatest(coalesce(want, 0) - coalesce(got, 0), 0) AS fn FROM f FULL JOIN e USING (file, rule_id))
  SELECT 'leakage' AS "check", CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / sum(tp + fp)::DOUBLE, 6) AS "precision",
    round(sum(tp) / sum(tp + fn)::DOUBLE, 6) AS recall FROM m"""))
def _l4(spark, sf):
    from .evaluation import evaluate

    notebooks, plain = st.notebooks(spark, sf), st.python_files(spark, sf)
    fixtures = notebooks.unionByName(plain).select(F.col("path").alias("file"), F.lit("leakage").alias("check"), "content")
    nb_k = st.events(spark, sf).filter("id % 97 <> 0 AND k % 6 < 3").select(
        F.concat(F.lit("nb/"), F.col("id").cast("string"), F.lit(".ipynb")).alias("file"), F.array(F.lit("leakage.label-proxy-feature")).alias("expected_ids"))
    py_k = st.table(spark, sf, "orders").filter("o_custkey % 5 < 3").select(
        F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("file"), F.array(F.lit("leakage.fit-on-test")).alias("expected_ids"))
    scores = evaluate(fixtures, nb_k.unionByName(py_k))
    return scores.select("check", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
