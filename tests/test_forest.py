"""Approximate neighbours: measured recall, copies of one point, odd tables, growth of the work."""

import math

import numpy as np
import pytest

from wardflow.operators import forest as fo
from wardflow.operators import neighbours as kn

SCHEMA = "id bigint, class_id int, features array<double>"


def _table(spark, x, labels):
    return spark.createDataFrame([(i, int(c), row) for i, (c, row) in enumerate(zip(labels, x.tolist()))], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def wide():
    """Clusters in 64 dimensions, two thirds of the rows in one class."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(30, 64)) * 3
    return centres[draw.integers(30, size=1800)] + draw.normal(size=(1800, 64)), (draw.random(1800) < 0.33).astype(int)


def _true_recall(x, labels, rows, k, ids=None):
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append(r)
    hit = total = 0
    for i in range(len(x)) if ids is None else ids:
        mates = np.flatnonzero(labels == labels[i])
        mates = mates[mates != i]
        far = np.sort(np.sqrt(((x[mates] - x[i]) ** 2).sum(1)))[:k]
        total += len(far)
        hit += sum(r["distance"] <= far[-1] * (1 + 1e-9) for r in got.get(i, []))
        for r in got.get(i, []):
            assert labels[r["neighbour_id"]] == labels[i] and r["neighbour_id"] != i
            assert math.isclose(r["distance"], math.dist(x[i], x[r["neighbour_id"]]), rel_tol=1e-9)
    return hit / total


def test_recall_against_brute_force(spark, wide):
    x, labels = wide
    result = fo.forest_neighbours(_table(spark, x, labels), 3, recall=0.93, leaf_rows=128, probes=200)
    rows = result.neighbours.collect()
    assert 0 < result.trees <= fo.MAX_TREES and result.recall >= 0.93
    assert _true_recall(x, labels, rows, 3) >= 0.9
    assert len({(r["id"], r["place"]) for r in rows}) == len(rows) == len({(r["id"], r["neighbour_id"]) for r in rows})


def test_visitors_and_refusal(spark, wide):
    x, labels = wide
    df = _table(spark, x, labels)
    some = fo.forest_neighbours(df, 2, recall=0.9, visitors=df.filter("id % 9 = 0"), leaf_rows=200)
    rows = some.neighbours.collect()
    assert {r["id"] for r in rows} == set(range(0, 1800, 9)) and _true_recall(x, labels, rows, 2, range(0, 1800, 9)) >= 0.87
    with pytest.raises(ValueError, match="recall"):
        fo.forest_neighbours(df, 3, recall=1.0, leaf_rows=16, max_trees=1)
    with pytest.raises(ValueError, match="too small"):
        fo.forest_neighbours(df, 10, leaf_rows=12)


def test_copies_of_one_point_are_dealt_into_parts(spark):
    """A third of all rows is one point: no leaf grows with it, and its copies are each other's neighbours."""
    draw = np.random.default_rng(8)
    x = np.concatenate([np.full((500, 8), 7.0), draw.normal(size=(1000, 8))])
    labels = np.zeros(1500, int)
    df = _table(spark, x, labels)
    rounds = 7
    leaves = fo._leaves(fo._projected(df, range(2), rounds * fo.BITS, 8, 1), rounds, 50, 1).collect()
    sizes = {}
    for r in leaves:
        key = (r["class_id"], r["tree"], r["node"], r["part"])
        sizes[key] = sizes.get(key, 0) + 1
    assert len(leaves) == 2 * 1500 == len({(r["id"], r["tree"]) for r in leaves}) and max(sizes.values()) <= 90
    rows = fo.forest_neighbours(df, 3, recall=0.9, leaf_rows=64).neighbours.filter("id < 500").collect()
    assert len(rows) == 1500 and all(r["distance"] == 0 and r["neighbour_id"] < 500 for r in rows)


def test_small_and_empty_tables(spark):
    df = _table(spark, np.array([[0.0], [1.0], [5.0], [2.0]]), np.array([0, 0, 0, 1]))
    rows = fo.forest_neighbours(df, 3).neighbours.collect()
    assert sorted((r["id"], r["neighbour_id"], r["place"]) for r in rows) == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 2), (2, 1, 1)]
    assert fo.forest_neighbours(df.filter("id < 0"), 3).neighbours.count() == 0


def test_pairs_met_grow_with_the_rows(spark):
    """Four times the rows: about four times the pairs inside leaves, not sixteen."""
    draw, met = np.random.default_rng(2), []
    for n in (500, 2000):
        df = _table(spark, draw.normal(size=(n, 16)), np.zeros(n, int))
        rounds = 3
        leaves = fo._leaves(fo._projected(df, range(1), rounds * fo.BITS, 16, 3), rounds, 64, 3)
        met.append(sum(r["count"] ** 2 for r in leaves.groupBy("class_id", "tree", "node", "part").count().collect()))
    assert met[1] < 7 * met[0]


def test_oversampling_over_the_forest(spark, wide):
    x, labels = wide
    made = kn.oversample(
        _table(spark, x, labels), 3, search=lambda p, k, **a: fo.forest_neighbours(p, k, recall=0.9, leaf_rows=128, **a).neighbours)
    counts = {(r["class_id"]): r["count"] for r in made.groupBy("class_id").count().collect()}
    assert counts[0] == counts[1] == max((labels == 0).sum(), (labels == 1).sum())


def test_recall_is_reached_where_the_trees_do_not_suffice(spark, monkeypatch):
    """Without structure, small leaves miss neighbours: leaves double, and after the last tree the exact search answers."""
    monkeypatch.setattr(fo, "MAX_TREES", 8)
    x, labels = np.random.default_rng(3).normal(size=(1200, 64)), np.zeros(1200, int)
    result = fo.forest_neighbours(_table(spark, x, labels), 3, recall=0.99, leaf_rows=16, probes=50)
    rows = result.neighbours.collect()
    assert result.recall >= 0.99 and result.trees == 8 and len(rows) == 3600 and _true_recall(x, labels, rows, 3) == 1.0
    monkeypatch.setattr(fo, "MAX_TREES", 64)
    result = fo.forest_neighbours(_table(spark, x, labels), 3, recall=0.99, leaf_rows=16, probes=50)
    assert 8 < result.trees < 64 and result.recall >= 0.99 and _true_recall(x, labels, result.neighbours.collect(), 3) >= 0.95


def test_rows_are_not_copied_to_cells_that_pivots_do_not_rule_out(spark, monkeypatch):
    """Without structure in many dimensions each row saw nearly every cell, and was written once for each."""
    written, cut = [], kn.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(kn, "cut_lineage", counted)
    x, labels = np.random.default_rng(6).normal(size=(1200, 32)), np.arange(1200) % 2
    rows = kn.nearest_neighbours(_table(spark, x, labels), 3, block_rows=64).collect()
    assert len(rows) == 3600 and _true_recall(x, labels, rows, 3) == 1.0 and max(written) <= 1200


def test_all_rows_meet_once(spark, monkeypatch):
    """Batches of trees that fall short are tried on the probes only."""
    asked, met = [], fo._met

    def counted(points, visitors, leaves, k):
        asked.append(1200 if visitors is None else visitors.count())
        return met(points, visitors, leaves, k)

    monkeypatch.setattr(fo, "_met", counted)
    x, labels = np.random.default_rng(3).normal(size=(1200, 32)), np.zeros(1200, int)
    result = fo.forest_neighbours(_table(spark, x, labels), 3, recall=0.95, leaf_rows=16, probes=40)
    assert result.trees > fo.BATCH and asked.count(1200) == 1 and set(asked[:-1]) == {40}
    assert _true_recall(x, labels, result.neighbours.collect(), 3) >= 0.9


def test_near_ties_and_copies_inside_a_block():
    import pandas as pd

    x = np.repeat(np.random.default_rng(9).integers(0, 3, size=(100, 4)).astype(float), 3, axis=0)
    block = pd.DataFrame({"id": np.arange(300)[::-1], "features": list(x)})
    got = kn._nearest_in_block(block, block.rename(columns={"id": "member_id", "features": "member"}), 3)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i, own in enumerate(block["id"]):
        mates = sorted((far[i, j], int(other)) for j, other in enumerate(block["id"]) if other != own)[:3]
        mine = got[got["id"] == own]
        assert list(zip(mine["distance"], mine["neighbour_id"])) == mates
    assert kn._nearest_in_block(block[:0], block.rename(columns={"id": "member_id", "features": "member"}), 3).empty
