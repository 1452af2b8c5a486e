"""Inputs of the registered queries, derived from the given tables by Spark (and, for the oracle, in SQL).

No flow file or code corpus comes with the tables, so rows of `events`, `orders`, `part`,
`customer`, `documents` and `embeddings` are rendered into flows, findings, notebooks, Python
files, requirement lists and scanner reports. Every input has one row per source row (no row is
left out or added to save work), and the expressions below read the same in Spark SQL and DuckDB.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CHECKS, CLASSES, PROTECTED_HOSTS, RULES, SCENARIOS, SEVERITY_LADDER, TAXONOMY
from ..session import ensure_checkpoint_dir
from ..sources.files import opened

NL, QUOTE = "chr(10)", "chr(39)"
_LABELS = [label for labels in TAXONOMY.values() for label in labels] + [f"zeroday_{c}" for c in "abcd"]
N_RULES = len(RULES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a table comes in fewer splits than there are cores.

    Rendering and parsing cost far more than moving the short source rows; a table with enough
    splits (any large one) is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Short rows over all cores, however the table is stored.

    Splits are cut by bytes, but a row group is read by one task: a large file of few row groups has as many splits as
    there are cores, and most of them are empty.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/wardflow-{uuid4().hex}/{name}"


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A rendered corpus as the table a corpus would be: written once per session, then only read."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STORED:
        path = scratch(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _STORED[at] = path
    return spark.read.parquet(_STORED[at])


def _pick(values, index: str, spark: bool) -> str:
    """Element `index` (from 0) of a fixed list in either dialect."""
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"element_at(array({items}), cast(({index}) + 1 AS int))" if spark else f"([{items}])[CAST(({index}) + 1 AS INT)]"


def _values(rows) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows) + ")"


# --- events as flows ----------------------------------------------------------------------------

def _flow_columns(spark: bool) -> str:
    label = _pick(_LABELS, f"(k * 7 + uid) % {len(_LABELS)}", spark)
    return f"""
      id, uid, k, et, v, ts,
      CASE WHEN et IN ('view', 'click') THEN 'normal' ELSE {label} END AS label,
      {_pick(('icmp', 'tcp', 'udp'), 'k % 3', spark)} AS protocol_type,
      CASE WHEN id % 5 = 0 AND k % 50 = 0 THEN 'svc_new' ELSE 'svc' || (k % 10) END AS service,
      {_pick(('REJ', 'S0', 'SF'), 'uid % 3', spark)} AS flag,
      CAST(uid % 60 AS INT) AS duration, CAST(floor(v * 100) AS BIGINT) AS src_bytes,
      CAST(k * uid AS BIGINT) AS dst_bytes, 0 AS land, k AS count, CAST(hour(ts) AS INT) AS hour_of_day,
      CAST(k AS DOUBLE) / 100 AS serror_rate, CAST(uid % 100 AS DOUBLE) / 100 AS same_srv_rate,
      CAST(id % 22 AS INT) AS difficulty_level,
      CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
      CASE WHEN uid % 4 = 0 THEN '10.0.0.' || (uid % 5) ELSE '192.168.1.' || (uid % 24) END AS destination_ip,
      CAST((id * 37 + k) % 1001 AS DOUBLE) / 1000 AS confidence
    """


NUMERIC_FLOW = ("duration", "src_bytes", "dst_bytes", "land", "count", "hour_of_day", "serror_rate", "same_srv_rate")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("uid"), F.col("event_type").alias("et"),
        F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k"), "ts",
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(events(spark, sf_dir), _flow_columns(True))


def _sql_select(df: DataFrame, columns: str) -> DataFrame:
    escaped = columns.replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql("SELECT " + escaped + " FROM {df}", df=df)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three imagined models on all flows: `(model, split, id, y, p)`."""
    from ..operators.flows import categorise, encode_category

    known = encode_category(categorise(flows(spark, sf_dir)))
    models = F.explode(F.array(*[F.struct(F.lit(f"m{i}").alias("model"), F.lit(t).alias("t")) for i, t in enumerate((8, 7, 9))]))
    right = (F.col("id") * 13 + F.col("k")) % 10 < F.col("t")
    return known.select("id", "k", F.col("class_id").alias("y"), F.when(F.col("split") == "test", "test").otherwise("val").alias("split"),
                        models.alias("m")).select("id", "k", "y", "split", "m.*").select(
        "model", "split", "id", "y", F.when(right, F.col("y")).otherwise((F.col("y") + F.col("k")) % 5).cast("int").alias("p"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with class probabilities `(id, k, ts, label, destination_ip, probs)`."""
    weight = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (
        1 + (F.col("id") * (i + 3) + F.col("k") * i) % 17 + F.when(i == F.col("k") % 5, F.col("id") % 200).otherwise(0)
    ))
    total = F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return flows(spark, sf_dir).select("id", "k", "ts", "label", "destination_ip", weight.alias("w")).withColumn(
        "probs", F.transform("w", lambda x: x.cast("double") / total)
    ).drop("w")


# --- events as findings -------------------------------------------------------------------------

_FINDING_COLUMNS = """
  'run-' || (uid % 10) AS run_id, id AS seq, k, et, uid, rule_id, "check", severity, category,
  'nb_' || (uid % 50) || '.ipynb' AS file,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k % 20 + 1 AS INT) END AS line_start,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k % 20 + 2 AS INT) END AS line_end,
  'value ' || id AS message, et || ' ' || k AS evidence
"""
# Every event is a finding of one of ten runs; run r knows the rules from number 2r on only, so runs differ. The
# eleventh run of `check_runs` has none.
_FINDING_RULE = f"(uid % 10) * 2 + k % ({N_RULES} - (uid % 10) * 2)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..dims import values_df
    from ..operators.rules import fix_struct

    indexed = values_df(spark, ("n", "rule_id", "`check`", "severity", "category", "fix_confidence", "fix_summary"),
                        [(i, *r) for i, r in enumerate(RULES)])
    kept = events(spark, sf_dir).withColumn("n", F.expr(_FINDING_RULE).cast("int"))
    replacement = F.when(F.col("k") % 10 == 1, F.concat(F.lit("x = "), F.col("k").cast("string")))
    fix = F.when(F.col("et") != "error", fix_struct(F.col("fix_summary"), F.col("fix_confidence"), replacement))
    joined = kept.join(indexed, "n").withColumn("fix", fix)
    return _sql_select(joined, _FINDING_COLUMNS.replace('"', "`") + ", fix")


def check_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every run, the run without findings included."""
    from ..dims import values_df

    run = (F.col("uid") % 11).alias("r")
    checks = values_df(spark, ("pos", "`check`"), [(i, c) for i, c in enumerate(CHECKS)])
    pairs = events(spark, sf_dir).select(run).distinct().crossJoin(checks)  # eleven runs, five checks
    return pairs.select(
        F.concat(F.lit("run-"), "r").alias("run_id"), "check",
        F.when((F.col("r") % 3 == 1) & (F.col("check") == "secrets"), "tool_missing").otherwise("ok").alias("tool_status"),
        (F.col("r") * 100 + F.col("pos")).cast("int").alias("duration_ms"),
    )


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(run_id, target, started_at, finished_at, invocation, extra)`: a run starts with its first event."""
    ev = events(spark, sf_dir)
    return ev.groupBy((F.col("uid") % 11).alias("r")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).select(
        F.concat(F.lit("run-"), "r").alias("run_id"), F.concat(F.lit("target-"), F.col("r") % 3).alias("target"),
        "started_at", "finished_at", F.lit("cli").alias("invocation"),
        F.create_map(F.lit("r"), F.col("r").cast("string")).alias("extra"),
    )


_VERDICT_COLUMNS = """
  run_id, CAST(seq AS INT) AS ord, rule_id,
  CASE WHEN seq % 35 = 0 THEN 'missing.ipynb' ELSE file END AS file, line_start,
  seq % 3 <> 0 AS confirmed,
  CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
  'because ' || seq AS reasoning
"""
_NARRATIVE_COLUMNS = """
  run_id, CAST(seq AS INT) AS ord,
  CASE WHEN seq % 15 = 0 THEN seq + 1000000000 ELSE seq END AS finding_idx, 'do ' || k AS narrative
"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(findings(spark, sf_dir), _VERDICT_COLUMNS)


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(findings(spark, sf_dir), _NARRATIVE_COLUMNS)


# --- events as notebooks ------------------------------------------------------------------------

def _lines(*parts: str) -> str:
    return f" || {NL} || ".join(f"({p})" for p in parts)


def _quoted(text: str) -> str:
    """SQL text with ~ for a single quote, which the two dialects escape differently."""
    return " || chr(39) || ".join(f"'{part}'" for part in text.split("~"))


_TOKEN = "'ghp_' || md5(CAST(id AS VARCHAR(20))) || 'abcd'"
_CELL_INSTALL = _lines(
    "'!pip install pkg' || (k % 7) || CASE WHEN k % 2 = 0 THEN '==1.' || k ELSE '' END || ' -q'",
    "CASE WHEN k % 5 = 0 THEN '%pip install tool-a tool-b>=2 # note' ELSE 'x = 1' END",
    "CASE WHEN k % 3 = 0 THEN '!wget https://data.example.org/' || id || '.csv' ELSE 'y = 2' END",
    "CASE WHEN k % 4 = 0 THEN '!sha256sum ' || id || '.csv' ELSE 'z = 3' END",
)
_CELL_LOAD = _lines(
    "'import joblib'", "'import pickle as pk'", "'import torch'", "'import numpy as np'", "CASE WHEN k % 7 = 3 THEN 'import json as pk' ELSE 'import json' END",
    f"""CASE et WHEN 'click' THEN {_quoted('m = joblib.load(~m.pkl~)')}
        WHEN 'view' THEN {_quoted('m = pk.load(open(~m.pkl~, ~rb~))')}
        WHEN 'purchase' THEN {_quoted('m = torch.load(~m.pt~')} || CASE WHEN k % 2 = 1 THEN ', weights_only=True)' ELSE ')' END
        WHEN 'signup' THEN {_quoted('m = np.load(~m.npy~, allow_pickle=')} || CASE WHEN k % 2 = 1 THEN 'False)' ELSE 'True)' END
        ELSE 'm = json.load(f)' END""",
)
_CELL_FEATURES = _lines(
    f"CASE WHEN k % 6 < 3 THEN {_quoted('cols = [~duration~, ~difficulty_level~, ~src_bytes~]')} WHEN k % 6 = 5 THEN {_quoted('cols = [~duration~, ~difficulty~ ~_level~, ~src_bytes~]')} ELSE {_quoted('cols = [~duration~, ~src_bytes~]')} END",
    f"""CASE k % 6 WHEN 1 THEN {_quoted('df = df.drop(columns=[~difficulty_level~])')}
        WHEN 2 THEN {_quoted('df = df.drop(~difficulty_level~, axis=1)')} ELSE 'df = df.copy()' END""",
)
_CELL_FIT = _lines(
    _quoted("le.fit([~DoS~, ~Normal~])"),
    "CASE WHEN k % 8 < 3 THEN 'X, y = smote.fit_resample(X, y)' ELSE 'X = X' END",
    """CASE k % 8 WHEN 1 THEN 'from sklearn.model_selection import train_test_split as tts' WHEN 2 THEN 'import sys'
       ELSE 'from sklearn.model_selection import train_test_split' END""",
    """CASE k % 8 WHEN 1 THEN 'X_train, X_test = tts(X, y)' WHEN 2 THEN 'X_train, X_test = X, X'
       ELSE 'X_train, X_test = train_test_split(X, y)' END""",
    "CASE WHEN k % 10 = 0 THEN 'scaler.fit(X_test)' ELSE 'scaler.fit(X_train)' END",
    f"CASE WHEN k % 11 = 0 THEN {_quoted('token = ~')} || {_TOKEN} || {QUOTE} ELSE 'done = True' END",
    "CASE WHEN id % 89 = 0 THEN 'def (:' ELSE 'pass' END",
)
# position among all cells, position among code cells, source
_CODE_CELLS = ((1, 0, _CELL_INSTALL), (2, 1, _CELL_LOAD), (4, 2, _CELL_FEATURES), (5, 3, _CELL_FIT))
_LEAKED = "'AKIA' || upper(substr(md5(CAST(id AS VARCHAR(20))), 1, 16))"


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "notebooks", _render_notebooks)


def _render_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(path, content)`: one notebook per event; source as text or list by turns, some JSON cut short."""
    ev = dealt(events(spark, sf_dir))
    texts = {0: "'# run ' || id", 3: "'features'"} | {cell: source for cell, _, source in _CODE_CELLS}
    sources = _sql_select(ev, ", ".join(["id", "k"] + [f"{texts[i]} AS c{i}" for i in range(6)] + [f"{_LEAKED} AS leaked"]))
    listed = lambda c: F.transform(F.split(c, "\n"), lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit("\n"), s)))
    saved = F.when(F.col("k") % 13 == 0, F.array(F.struct(F.array(F.concat(F.lit("seen:\n"), F.col("leaked"), F.lit("\n"))).alias("text"))))
    nothing = F.slice(F.array(F.struct(F.array(F.lit("")).alias("text"))), 1, 0)

    def document(shape):
        return F.to_json(F.struct(F.array(*[F.struct(
            F.lit("markdown" if i in (0, 3) else "code").alias("cell_type"), shape(F.col(f"c{i}")).alias("source"),
            (F.coalesce(saved, nothing) if i == 5 else nothing).alias("outputs"),
        ) for i in range(6)]).alias("cells")))

    content = F.when(F.col("id") % 2 == 0, document(lambda c: c)).otherwise(document(listed))
    cut = F.when(F.col("id") % 97 == 0, F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content)
    return sources.select(F.concat(F.lit("nb/"), F.col("id").cast("string"), F.lit(".ipynb")).alias("path"), cut.alias("content"))


# --- orders as Python files, part as requirement lists, customer and orders as scanner reports -----

_PYTHON = _lines(
    "'from sklearn.model_selection import train_test_split'",
    """CASE o_orderkey % 4 WHEN 0 THEN 'a = train_test_split(X, shuffle=False)' WHEN 1 THEN 'a = train_test_split(X, shuffle=False, stratify=y)'
       WHEN 2 THEN 'a = train_test_split(X)' ELSE 'a = other.train_test_split(X, shuffle=False)' END""",
    """CASE o_custkey % 5 WHEN 0 THEN 's.fit(X_test)' WHEN 1 THEN 's.fit_transform(X_test_scaled, y)' WHEN 2 THEN 's.fit(x_test)'
       WHEN 3 THEN 's.fit(X_train)' ELSE 's.fit(test_x, y)' END""",
    f"CASE WHEN o_orderkey % 3 = 0 THEN {_quoted('target_class = [~label_encoded~, ~ok~]')} ELSE 'n = 1' END",
)
_REQUIREMENTS = _lines(
    "'# for ' || p_partkey", "replace(p_name, ' ', '-') || CASE WHEN p_size % 2 = 0 THEN '==' || p_size ELSE '' END", "''",
    "'-r base.txt'", "'  lib' || p_size || ' '", "'git+https://example.org/x'", "''",
)
_ADVISORY = """
  '{"dependencies":[{"name":"lib' || (c_custkey % 9) || '","version":"' || c_nationkey || '","vulns":[{"id":"V-' || c_custkey ||
  '","fix_versions":["1","2"],"description":" ' || c_mktsegment || ' "},"bad"]},7,{"vulns":[{"fix_versions":[]}]}]' ||
  CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '}' END
"""
_PATTERN = """
  '{"results":[{"check_id":"a.b.ml-hygiene.r' || (o_orderkey % 5) || '","path":"f' || o_custkey || '.py","start":{"line":' ||
  (o_orderkey % 50 + 1) || '},"end":{"line":' || (o_orderkey % 50 + 2) || '},"extra":{"lines":" x = 1 ","message":" m' || o_orderkey ||
  ' ","severity":"' || CASE o_orderkey % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'CRITICAL' ELSE 'ODD' END ||
  '"}},{"check_id":7},"junk",{"check_id":"other","path":"g.py","start":{"line":"1"},"end":{"line":1},"extra":{}}]' ||
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '}' END
"""
_BASELINE = """
  '{"schema_version":1,"fixtures":[{"file":"f' || p_partkey || '","expected_ids":["a","a","b' || (p_size % 3) || '"]},{"file":"g' ||
  p_partkey || '","expected_ids":[]}]}'
"""
_FIXTURE_PATH = """
  '/data/fx/' || CASE o_orderkey % 7 WHEN 0 THEN 'leakage' WHEN 1 THEN 'deserialization' WHEN 2 THEN 'secrets' WHEN 3 THEN 'supply_chain'
  WHEN 4 THEN 'adversarial' WHEN 5 THEN 'semgrep' ELSE 'docs' END || '/f' || o_orderkey || CASE o_custkey % 3 WHEN 0 THEN '.ipynb' WHEN 1 THEN '.py' ELSE '.md' END
"""
_MODEL_PATH = """
  '/data/' || CASE o_orderkey % 5 WHEN 0 THEN '.venv/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'venv2/' ELSE 'models/' END || o_orderkey ||
  CASE o_custkey % 3 WHEN 0 THEN '.h5' WHEN 1 THEN '.keras' ELSE '.onnx' END
"""


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "python", _render_python)


def _render_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")), f"'src/' || o_orderkey || '.py' AS path, {_PYTHON} AS content")


def requirement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(table(spark, sf_dir, "part"), f"'p' || p_partkey || '/requirements.txt' AS path, {_REQUIREMENTS} AS content")


def advisory_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(table(spark, sf_dir, "customer"), f"'c' || c_custkey || '/requirements.txt' AS file, {_ADVISORY} AS payload")


def pattern_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(table(spark, sf_dir, "orders"), f"{_PATTERN} AS payload")


def baseline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(table(spark, sf_dir, "part"), f"{_BASELINE} AS payload")


def order_paths(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _sql_select(table(spark, sf_dir, "orders"), f"{_MODEL_PATH if kind == 'model' else _FIXTURE_PATH} AS path")


# A project per supplier: path and content of each of its files.
_PROJECT = """CASE s_nationkey % 6 WHEN 0 THEN 'leakage' WHEN 1 THEN 'deserialization' WHEN 2 THEN 'secrets' WHEN 3 THEN 'supply_chain'
  WHEN 4 THEN 'adversarial' ELSE 'docs' END || '/s' || s_suppkey"""
_PROJECT_FILES = (
    ("'/main.py'", "'x = ' || s_suppkey"), ("'/pkg/__init__.py'", "'y = ' || s_suppkey"), ("'/pkg/.hidden.py'", "s_name"), ("'/pkg/empty.py'", "''"),
    ("'/notes/deep/run.ipynb'", "s_name || s_nationkey"), ("'/.venv/lib/run.ipynb'", "'run ' || s_suppkey"), ("'/notes/run.ipynb.bak'", "s_name"),
    ("CASE s_suppkey % 3 WHEN 0 THEN '/requirements.txt' WHEN 1 THEN '/requirements-dev.txt' ELSE '/reqs.txt' END", "'lib==1.' || s_suppkey"),
    ("CASE s_suppkey % 3 WHEN 0 THEN '/models/net.h5' WHEN 1 THEN '/models/net.keras' ELSE '/models/net.onnx' END", "s_name"),
    ("'/node_modules/net.h5'", "s_name"),
)


def projects(spark: SparkSession, sf_dir: str) -> str:
    """The folder of all projects, their files written by the executors once per session."""
    at = (spark.sparkContext.applicationId, sf_dir, "projects")
    if at not in _STORED:
        root = scratch(spark, "projects")

        def write(batches):
            for batch in batches:
                for file in batch.to_pylist():
                    system, inside, _ = opened(f"{root}/{file['path']}")
                    system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(inside, compression=None) as out:
                        out.write(file["content"].encode())
                yield batch.select(["path"])

        files = F.array(*[F.struct(F.expr(f"{_PROJECT} || {p}").alias("path"), F.expr(c).alias("content")) for p, c in _PROJECT_FILES])
        spread(table(spark, sf_dir, "supplier")).select(F.inline(files)).mapInArrow(write, "path string").count()
        _STORED[at] = root
    return _STORED[at]


# Whole document texts, with a token of each format put behind those whose number asks for it.
_PLANTED = f"""
  text || {NL} || CASE doc_id % 9
    WHEN 0 THEN 'a = sk-ant-api03-' || md5(CAST(doc_id AS VARCHAR(20)))
    WHEN 1 THEN 'b = AKIA' || upper(substr(md5(CAST(doc_id AS VARCHAR(20))), 1, 16))
    WHEN 2 THEN 'c = ghp_' || md5(CAST(doc_id AS VARCHAR(20))) || 'wxyz'
    WHEN 3 THEN 'd = hf_' || md5(CAST(doc_id AS VARCHAR(20)))
    WHEN 4 THEN 'e = sk-' || md5(CAST(doc_id AS VARCHAR(20))) || ' sk-proj-' || md5(CAST(doc_id AS VARCHAR(20)))
    WHEN 5 THEN '-----BEGIN RSA PRIVATE KEY-----'
    WHEN 6 THEN 'g = xoxb-' || md5(CAST(doc_id AS VARCHAR(20)))
    WHEN 7 THEN 'h = postgres://user' || doc_id || ':pw@db.example.org/x'
    ELSE 'plain' END
"""


# Whole pages, with a token behind the markup of every second one.
_PAGE = """
  html || chr(10) || CASE page_id % 4 WHEN 0 THEN '<b>ghp_' || md5(CAST(page_id AS VARCHAR(20))) || 'abcd</b>'
    WHEN 2 THEN 'key: AKIA' || upper(substr(md5(CAST(page_id AS VARCHAR(20))), 1, 16)) || ';' ELSE '<p>plain</p>' END
"""


def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(table(spark, sf_dir, "pages"), f"CAST(page_id AS STRING) AS path, {_PAGE.replace('VARCHAR(20)', 'STRING')} AS text")


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "documents", _render_documents)


def _render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql_select(spread(table(spark, sf_dir, "documents")), f"CAST(doc_id AS STRING) AS path, {_PLANTED.replace('VARCHAR(20)', 'STRING')} AS text")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(id, class_id, features)` from the embeddings, all of them."""
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("id"), F.col("label").alias("class_id"), F.col("embedding").cast("array<double>").alias("features")
    )


# --- the same inputs in DuckDB ------------------------------------------------------------------

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """SELECT event_id AS id, user_id AS uid, event_type AS et, value AS v,
                         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events"""),
    "flows": (("ev",), f"SELECT {_flow_columns(False)} FROM ev"),
    "tax": ((), "SELECT * FROM " + _values([(label, c) for c, labels in TAXONOMY.items() for label in labels]) + " t(label, category)"),
    "cls": ((), "SELECT * FROM " + _values([(c, i) for i, c in enumerate(CLASSES)]) + " t(category, class_id)"),
    "cat": (("flows", "tax", "cls"), """
        SELECT f.*, coalesce(t.category, 'R2L') AS category, c.class_id FROM flows f LEFT JOIN tax t USING (label)
        LEFT JOIN cls c ON c.category = coalesce(t.category, 'R2L')"""),
    "preds": (("cat",), """
        SELECT model, CASE WHEN split = 'test' THEN 'test' ELSE 'val' END AS split, id, class_id AS y,
               CAST(CASE WHEN (id * 13 + k) % 10 < t THEN class_id ELSE (class_id + k) % 5 END AS INT) AS p
        FROM cat, (VALUES ('m0', 8), ('m1', 7), ('m2', 9)) m(model, t)"""),
    "scored": (("flows",), """
        SELECT id, k, ts, label, destination_ip, list_transform(w, lambda x: CAST(x AS DOUBLE) / list_sum(w)) AS probs FROM (
          SELECT *, list_transform([0, 1, 2, 3, 4], lambda i: 1 + (id * (i + 3) + k * i) % 17
                                   + CASE WHEN i = k % 5 THEN id % 200 ELSE 0 END) AS w FROM flows)"""),
    "rules": ((), "SELECT * FROM " + _values([(i, *r) for i, r in enumerate(RULES)])
              + ' t(n, rule_id, "check", severity, category, fix_confidence, fix_summary)'),
    "fi": (("ev", "rules"), f"""
        SELECT {_FINDING_COLUMNS}, et <> 'error' AS has_fix, fix_confidence, fix_summary,
               CASE WHEN k % 10 = 1 AND et <> 'error' THEN 'x = ' || k END AS fix_replacement
        FROM ev JOIN rules ON n = {_FINDING_RULE}"""),
    "sev": ((), "SELECT * FROM " + _values([(s, i) for i, s in enumerate(SEVERITY_LADDER)]) + " t(severity, rnk)"),
    "checks": ((), "SELECT * FROM " + _values([(i, c) for i, c in enumerate(CHECKS)]) + ' t(pos, "check")'),
    "cr": (("ev", "checks"), """
        SELECT 'run-' || r AS run_id, "check", CASE WHEN r % 3 = 1 AND "check" = 'secrets' THEN 'tool_missing' ELSE 'ok' END AS tool_status,
               CAST(r * 100 + pos AS INT) AS duration_ms FROM (SELECT DISTINCT uid % 11 AS r FROM ev), checks"""),
    "rr": (("ev",), """
        SELECT 'run-' || r AS run_id, 'target-' || (r % 3) AS target, strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS started_at,
               strftime(b, '%Y-%m-%dT%H:%M:%SZ') AS finished_at
        FROM (SELECT uid % 11 AS r, min(ts) AS a, max(ts) AS b FROM ev GROUP BY 1)"""),
    "vd": (("fi",), f"SELECT {_VERDICT_COLUMNS} FROM fi"),
    "na": (("fi",), f"SELECT {_NARRATIVE_COLUMNS} FROM fi"),
    "nbc": (("ev",), " UNION ALL ".join(
        f"SELECT id, k, et, 'nb/' || id || '.ipynb' AS path, {code} AS code_idx, {cell} AS cell_idx, {source} AS source FROM ev WHERE id % 97 <> 0"
        for cell, code, source in _CODE_CELLS)),
    "nb": (("ev",), "SELECT *, 'nb/' || id || '.ipynb' AS path FROM ev WHERE id % 97 <> 0"),
    "nbok": (("nb",), "SELECT * FROM nb WHERE id % 89 <> 0"),
    "py": ((), f"SELECT *, 'src/' || o_orderkey || '.py' AS path, {_PYTHON} AS content FROM orders"),
    "rq": ((), f"SELECT *, 'p' || p_partkey || '/requirements.txt' AS path, {_REQUIREMENTS} AS content FROM part"),
    "docs": ((), f"SELECT CAST(doc_id AS VARCHAR) AS path, {_PLANTED} AS text FROM documents"),
    "pgs": ((), f"SELECT CAST(page_id AS VARCHAR) AS path, {_PAGE} AS text FROM pages"),
    "pts": ((), "SELECT vec_id AS id, label AS class_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"),
    "hosts": ((), "SELECT * FROM " + _values(PROTECTED_HOSTS) + " t(ip, role)"),
    "scen": ((), "SELECT * FROM " + _values(
        [(s[0], r, 1, len(s[1]), s[3], s[4], s[6]) for s in SCENARIOS for r in s[1]]
        + [(s[0], r, 0, len(s[1]), s[3], s[4], s[6]) for s in SCENARIOS for r in s[2]]
    ) + " t(scenario_id, rule_id, needed, n_required, baseline, name, narrative)"),
    "fxp": ((), f"SELECT {_FIXTURE_PATH} AS path FROM orders"),
    "prj": ((), " UNION ALL ".join(f"SELECT {_PROJECT} || {p} AS path, {c} AS content FROM supplier" for p, c in _PROJECT_FILES)),
    "mdp": ((), f"SELECT {_MODEL_PATH} AS path FROM orders"),
}


def sql(needs: str, body: str) -> str:
    """`body` with the named inputs, and what they need, in front of it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in _CTES[name][0]:
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in needs.split():
        add(name)
    ctes = ", ".join(f"{n} AS ({_CTES[n][1]})" for n in wanted)
    extra = body.lstrip()
    if extra.startswith("WITH "):
        return f"WITH {ctes}, {extra[5:]}" if wanted else extra
    return f"WITH {ctes} {extra}" if wanted else extra
