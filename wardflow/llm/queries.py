"""The registered queries of the operators; SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backtrack, bpe, covertree, manifest, mixing, neardup, periods, pii, projected, quality, secrets, sharding, substring
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def digest_rows(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.name for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, base), F.sha2(secrets.joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query
def op8_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_products(table(spark, sf_dir, "embeddings"))


@query
def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected.nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = backtrack.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", "n_tokens", F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def plant_periods(docs: DataFrame) -> DataFrame:
    """The contract's change to one document in ten: from word a on, its words a to a+p-1 over and over."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    listed = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn("n", F.size("w"))
    placed = listed.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8)) + 1).cast("int"))
    rest = F.col("n") - F.col("a")
    cycle = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), rest)), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(plant_periods(table(spark, sf_dir, "documents")))
    runs = F.col("runs")  # by start, then period, so the first of equals stays
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate(runs, none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "best.*", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaf = manifest.leaf_digest([*row, F.col("text")])
    claim = F.when(tampered, manifest.leaf_digest([*row, lowered]))
    paths = manifest.build(docs, leaf, F.coalesce(claim, leaf)).paths()
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = paths.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), manifest.fold(F.col("claim"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


# CRC-32 of the decimal id; DuckDB has no function for it.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::UBIGINT),
  lambda c, x: list_reduce(range(8)::UBIGINT[], lambda r, _: xor(r >> 1, 3988292384::UBIGINT * (r & 1)), xor(c, x)), 4294967295::UBIGINT))::BIGINT"""

SQL["op12_periodic_runs"] = rf"""
WITH RECURSIVE o AS (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
v AS (SELECT doc_id, n, 1::BIGINT AS m, w AS f FROM d WHERE n >= 24
  UNION ALL SELECT doc_id, n, 2 * m, list_transform(range(1, len(f) - m + 1), lambda i: md5(f[i] || ' ' || f[i + m])) FROM v WHERE 3 * (m + 1) <= n),
e AS (SELECT doc_id, m, unnest(range(len(f))) AS i, unnest(f) AS f FROM v),
s AS (SELECT doc_id, m, i, lead(i) OVER (PARTITION BY doc_id, m, f ORDER BY i) - i AS p FROM e),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, m, p ORDER BY i) AS island FROM s WHERE 2 * p > m AND p <= m),
r AS (SELECT doc_id, min(i) AS start, count(*) + m - 1 + p AS length, p AS period FROM k GROUP BY doc_id, m, p, island HAVING count(*) + m - 1 + p >= greatest(24, 3 * p)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS best FROM r),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT z.doc_id, string_agg(z.f, ' ' ORDER BY z.i) AS t FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS f FROM d) z ANTI JOIN x USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.best = 1 LEFT JOIN c ON c.doc_id = d.doc_id
"""

SQL["op13_merkle_manifest"] = rf"""
WITH RECURSIVE f AS (SELECT doc_id, lang, source, n_chars, text, coalesce({_CRC} % 3 = 0, false) AS t FROM documents),
b AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM f),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(text) || ':' || CASE WHEN t THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS claim FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
v AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS d FROM n GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range((len(d) + 7) // 8), lambda j: sha256(array_to_string(d[8 * j + 1:8 * j + 8], ''))) FROM v WHERE len(d) > 1),
s AS (SELECT lang, d[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM v WHERE len(d) = 1),
w AS (SELECT 0 AS level, list(subroot ORDER BY i) AS d FROM s
  UNION ALL SELECT level + 1, list_transform(range((len(d) + 7) // 8), lambda j: sha256(array_to_string(d[8 * j + 1:8 * j + 8], ''))) FROM w WHERE len(d) > 1),
r AS (SELECT d[1] AS root FROM w WHERE len(d) = 1),
u AS (SELECT 0 AS part, lang, level, d FROM v WHERE len(d) > 1 UNION ALL SELECT 1, s.lang, w.level, w.d FROM w CROSS JOIN s WHERE len(w.d) > 1),
o AS (SELECT u.part, u.lang, u.level, u.d, s.i FROM u JOIN s ON u.lang IS NOT DISTINCT FROM s.lang),
a AS (SELECT n.doc_id, n.leaf, n.claim, o.part, o.level, o.d, CASE WHEN o.part = 0 THEN n.i ELSE o.i END // CAST(pow(8, o.level) AS BIGINT) AS k, n.i AS seat, n.lang
  FROM n JOIN o ON n.lang IS NOT DISTINCT FROM o.lang),
e AS (SELECT doc_id, leaf, claim, lang, seat, list(struct_pack(a := array_to_string(d[k // 8 * 8 + 1:k], ''), b := array_to_string(d[k + 2:k // 8 * 8 + 8], '')) ORDER BY part, level) AS path
  FROM a GROUP BY ALL),
p AS (SELECT n.doc_id, n.leaf, n.claim, n.lang, coalesce(e.path, []) AS path FROM n LEFT JOIN e ON e.lang IS NOT DISTINCT FROM n.lang AND e.seat = n.i),
q AS (SELECT doc_id, leaf, lang, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) AS proof_sha256, claim AS node, path, 0 AS step FROM p
  UNION ALL SELECT doc_id, leaf, lang, proof_sha256, sha256(path[step + 1].a || node || path[step + 1].b), path, step + 1 FROM q WHERE step < len(path))
SELECT q.doc_id, q.leaf, s.subroot, r.root, q.proof_sha256, q.node AS folded_root, q.node = r.root AS verified
FROM q JOIN s ON q.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r WHERE q.step = len(q.path)
"""

SQL["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, c.m = d.doc_id AS kept FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL["op8_dual_tree_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""
