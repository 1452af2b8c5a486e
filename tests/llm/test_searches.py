"""Vector searches against brute force."""

import numpy as np
import pytest

from wardflow.llm import blocks, covertree, projected

SCHEMA = "vec_id bigint, embedding array<float>, label int, node int, v int, q int"


def table(spark, x, ids=None, extra=()):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(v) for v in np.float32(row)], 0, 1, 1, 1) for i, row in zip(ids, x)]
    return spark.createDataFrame(rows + [(*e, 0, 1, 1, 1) for e in extra], SCHEMA)


ODD = [(None, [1.0, 2.0]), (50_000, None), (50_050, [1.0, None]), (50_100, [float("nan"), 1.0]), (50_150, [float("inf"), 1.0])]


def vectors(kind, n=700, d=12, seed=4):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d))
    if kind == "clusters":
        x = draw.normal(size=(9, d))[draw.integers(0, 9, n)] * 3 + 0.2 * x
    if kind == "copies":
        x[100:400] = x[7]
    return np.float32(x)


def products(x, ids, every, k):
    whole, out = np.floor(256 * x.astype(np.float64)).astype(np.int64), {}
    for i in np.flatnonzero(ids % every == 0):
        other = ids != ids[i]
        s, o = (whole @ whole[i])[other], ids[other]
        first = np.lexsort((o, -s))[:k]
        out[int(ids[i])] = list(zip(range(1, k + 1), o[first].tolist(), s[first].tolist()))
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_top_products_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr("wardflow.llm.blocks.BLOCK_ROWS", 60)
    x = vectors(kind)
    assert collected(covertree.top_products(table(spark, x, extra=ODD), nodes=6)) == products(x, np.arange(len(x)), 50, 5)


def test_top_products_small_and_odd_tables(spark):
    x = vectors("even", 3)
    assert collected(covertree.top_products(table(spark, x))) == products(x, np.arange(3), 50, 2)
    assert covertree.top_products(table(spark, x).limit(0)).count() == 0
    big = np.array([[3e6, 1.0], [2e6, 3e6], [1e6, -5.0]])
    got = collected(covertree.top_products(table(spark, big)))[0]
    whole = [[int(np.floor(256 * float(np.float32(v)))) for v in row] for row in big]
    want = sorted(((sum(a * b for a, b in zip(whole[0], w)), -i) for i, w in enumerate(whole) if i), reverse=True)
    assert [(v, s) for _, v, s in got] == [(-i, s) for s, i in want]


def test_cover_tree_covers():
    x = vectors("clusters", 2000).astype(np.float64)
    todo, seen = [covertree.cover_tree(x)], []
    while todo:
        node = todo.pop()
        assert np.linalg.norm(x[node.points] - node.centre, axis=1).max() <= node.radius + 1e-9
        assert not node.children or sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        todo += node.children
        seen += [] if node.children else node.points.tolist()
    assert sorted(seen) == list(range(2000))


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_nearest_recall(spark, monkeypatch, kind):
    monkeypatch.setattr("wardflow.llm.blocks.BLOCK_ROWS", 90)
    x = vectors(kind, 900)
    extra = [*ODD, (50_200, [0.0] * 12)]
    got, hits, asked = collected(projected.nearest(table(spark, x, extra=extra))), 0, 0
    for i in range(0, 900, 100):
        away = np.sqrt(((x.astype(np.float64) - x[i].astype(np.float64)) ** 2).sum(1))
        away[i] = np.inf
        kth = np.sort(away)[9]
        found = got[i]
        assert len(found) == 10 and [s for _, _, s in found] == sorted(s for _, _, s in found)
        assert all(abs(away[v] - s) < 1e-12 for _, v, s in found)
        hits += sum(s <= kth for _, _, s in found)
        asked += 10
    assert set(got) == set(range(0, 900, 100)) and hits >= 0.9 * asked


def test_nearest_small_tables(spark):
    x = vectors("even", 4)
    assert len(collected(projected.nearest(table(spark, x)))[0]) == 3
    assert projected.nearest(table(spark, x).limit(0)).count() == 0


def test_chi_square():
    assert projected.chi_square(projected.chi_square_at(0.98)) == pytest.approx(0.98)
    draw = np.random.default_rng(1).normal(size=(200_000, projected.DIMENSIONS))
    assert abs(((draw**2).sum(1) < 8).mean() - projected.chi_square(8.0)) < 0.01


def test_more_nodes_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr("wardflow.llm.blocks.BLOCK_ROWS", 10)
    monkeypatch.setattr("wardflow.llm.blocks.LEAST_NODES", 4)
    assert blocks.node_count(spark.range(1000)) == 200 and blocks.node_count(spark.range(3)) == 4
    monkeypatch.setattr("wardflow.llm.blocks.MOST_NODES", 50)
    assert blocks.node_count(spark.range(1000)) == 50
    monkeypatch.setattr("wardflow.llm.blocks.ROUTES", 7)
    x = vectors("clusters", 500)
    assert collected(covertree.top_products(table(spark, x))) == products(x, np.arange(500), 50, 5)
    got = collected(projected.nearest(table(spark, x)))
    assert set(got) == {0, 100, 200, 300, 400} and all(len(found) == 10 for found in got.values())


def test_meetings_lose_no_pair_that_matters():
    draw = np.random.default_rng(3)
    q, x = (vectors("clusters", n, seed=s).astype(np.float64) for n, s in ((300, 1), (2000, 2)))
    middle = x[draw.choice(len(x), 40, replace=False)]
    node = ((x[:, None] - middle) ** 2).sum(2).argmin(1)
    radius = np.array([np.linalg.norm(x[node == n] - middle[n], axis=1).max() for n in range(40)])
    bound = np.sort(q @ x.T, axis=1)[:, -5]
    pairs = [pair for who, where in covertree.meetings(covertree.cover_tree(q), q, bound, middle, radius) for pair in zip(who.tolist(), where.tolist())]
    must = {(int(a), int(node[b])) for a, b in zip(*np.nonzero(q @ x.T >= bound[:, None]))}
    assert must <= set(pairs) and len(pairs) == len(set(pairs)) < 300 * 40 / 2


def test_shared_ids_and_vectors_of_other_lengths(spark):
    """Rows with the query's id are its own, one of them asks (whose bytes are least); missing components count as 0."""
    rows = [(0, [2.0, 1.0]), (0, [1.0]), (1, [3.0]), (2, [0.5, 0.5, 9.0]), (3, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 1, 1, 1) for r in rows], SCHEMA)
    assert collected(covertree.top_products(df)) == {0: [(1, 1, 3 << 16), (2, 3, 1 << 16), (3, 2, 1 << 15)]}
    assert [(r, v) for r, v, _ in collected(projected.nearest(df))[0]] == [(1, 1), (2, 3), (3, 2)]  # (2, 1) asks; a tie
