"""The manifest against a plain Merkle tree, small blocks so that several rounds are needed, odd rows and addresses."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.llm import manifest, queries

from .conftest import SCHEMA, prose


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_tree(leaves):
    """Root and, per leaf, the siblings left and right of it on the way up."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            at[k] = i // 8
        level = [H(*level[j:j + 8]) for j in range(0, len(level), 8)]
    return level[0], paths


def plain(docs):
    """Rows of the contract: doc_id, leaf, subroot, root, proof, folded root, verified."""
    groups = {}
    for doc_id, text, lang, source, n_chars in docs:
        head = field(doc_id) + field(source) + field(lang) + field(n_chars)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        groups.setdefault(lang, []).append((doc_id, H(head, field(text)), H(head, field(lower(text) if tampered else text))))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        rows = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = (rows, *plain_tree([r[1] for r in rows]))
    root, tops = plain_tree([trees[g][1] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        rows, subroot, paths = trees[g]
        for (doc_id, leaf, claim), path in zip(rows, paths):
            for left, right in path + top:
                claim = H(left, claim, right)
            out.append((doc_id, leaf, subroot, root, H(*[a + b for a, b in path + top]), claim, claim == root))
    return sorted(out, key=str)


def digests(row):
    return [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]


def build(df, block_levels):
    leaf = manifest.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return manifest.build(df, leaf, leaf, block_levels=block_levels)


def run_query(spark, docs, tmp_path):
    spark.createDataFrame(docs, SCHEMA).withColumn("path", F.lit("p")).withColumn("leaf", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(spark, odd_rows, tmp_path):
    docs = odd_rows + [(20, "Só", None, None, None), (-3, "A", None, "é", 2), (21, "x", "", "a", 1), (22, "y", "ü", "a", 1)]
    got = run_query(spark, docs, tmp_path)
    assert got == plain(docs) and {r[6] for r in got} == {True, False}


def test_one_row_and_no_row(spark, tmp_path):
    docs = [(5, "Alone", "en", "a", 5)]
    got = run_query(spark, docs, tmp_path / "one")
    assert got == plain(docs) and got[0][1] in (got[0][2],) and got[0][4] == H("")
    assert run_query(spark, [], tmp_path / "none") == []


@pytest.mark.parametrize("block_levels", [1, 2, 4])
def test_block_heights(spark, block_levels):
    """Groups of many sizes, one with most rows, many equal rows: the same tree whatever the height of a block."""
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "e": 65, "f": 513, "g": 7, None: 2, "h": 73, "i": 12, "j": 1}
    docs = [(k, prose(k, 3), g, "s", k) for g, n in sizes.items() for k in range(n)] + [(7, "Same", "f", "s", 1)] * 400
    made = build(spark.createDataFrame(docs, SCHEMA).repartition(5), block_levels)
    rows = made.paths().select("doc_id", "leaf", "subroot", "root", F.expr("transform(path, s -> s.left || s.right)").alias("p"), manifest.fold(F.col("leaf"), F.col("path")).alias("f")).collect()
    want = [r[:5] for r in plain(docs)]
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], H(*r["p"])) for r in rows), key=str) == sorted(want, key=str)
    assert {r["f"] for r in rows} == {made.root}
    assert len(made.rounds) == {1: 4, 2: 2, 4: 1}[block_levels]


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_addresses(levels):
    """Every node has a place of its own; a lower tree lies in one stretch behind the upper one."""
    at = [manifest.addresses(levels)[d] for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range(manifest.node_count(levels)))
    upper = levels // 2
    if upper:
        assert max(max(a.tolist()) for a in at[:upper]) == manifest.node_count(upper) - 1
        size = manifest.node_count(levels - upper)
        for d in range(upper, levels):
            tree = np.arange(8**d) >> 3 * (d - upper)
            assert ((at[d] - manifest.node_count(upper)) // size == tree).all()
