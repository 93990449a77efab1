"""Round 5: neighbours and density clusters by a tree over all dimensions."""

import random

import numpy as np
import pytest

from fairplay.operators import neighbors as NB
from tests.test_neighbors import brute_knn, found, frame
from tests.test_properties import brute_dbscan


def crowds(n, dims=8, seed=3):
    """Crowds that differ in the last dimensions only: the plane of the first two tells none from another."""
    r = random.Random(seed)
    return [[r.gauss(0, 1e-3), r.gauss(0, 1e-3), *(r.gauss(0, 0.1) + (9 * (i % 6) if j == i % 3 else 0) for j in range(dims - 2))] for i in range(n)]


def test_neighbours_are_sought_in_all_dimensions(spark, monkeypatch):
    x, seen, plain = crowds(360), [], NB._leaf_pairs

    def counted(asks, tree):
        out = plain(asks, tree)
        seen.append(out.count())
        return out

    monkeypatch.setattr(NB, "_leaf_pairs", counted)
    assert found(spark, x, 4, leaf_size=20) == brute_knn(x, 4)
    assert sum(seen) < 360 * 5 * 8  # the plane let all 360 * 359 pairs through


def test_copies_are_neighbours_by_the_smaller_id(spark):
    x = [[1.0, 2.0]] * 30 + [[5.0, 5.0]] * 2
    got = found(spark, x, 3)
    assert [j for j, _ in got[0]] == [1, 2, 3] and [j for j, _ in got[2]] == [0, 1, 3] and [j for j, _ in got[29]] == [0, 1, 2]
    assert got[30] == [(31, 0.0), (0, pytest.approx(5.0)), (1, pytest.approx(5.0))]
    assert got == brute_knn(x, 3)


def test_points_without_a_place_have_no_neighbours(spark):
    x = [[0.0, 0.0], [0.1, 0.0], [0.0, 0.1], [float("nan"), 0.0], [float("inf"), 0.0]]
    assert sorted(found(spark, x, 2)) == [0, 1, 2]
    got = {r["id"]: (r["label"], r["is_core"]) for r in NB.dbscan(frame(spark, x), 0.5, 3).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (-1, False), 4: (-1, False)}


def test_density_keeps_no_pairs(spark, monkeypatch):
    x, rows, plain = crowds(300), [], NB.cut_lineage

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(NB, "cut_lineage", counted)
    got = {q["id"]: q for q in NB.dbscan(frame(spark, x), 1.0, 5).collect()}
    core, label = brute_dbscan(np.array(x), 1.0, 5)
    assert [got[i]["is_core"] for i in range(len(x))] == list(core) and [got[i]["label"] for i in range(len(x))] == list(label)
    assert len(set(label)) > 1 and sum(rows) < 300 * 10  # the pairs within eps were kept before


@pytest.mark.parametrize("seed, eps, least, leaf", [(1, 0.5, 4, 8), (2, 0.9, 3, 16), (3, 6.0, 5, 4)])
def test_density_across_leaves_and_whole_nodes(spark, seed, eps, least, leaf):
    r = random.Random(seed)
    x = [[r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 0.2)] for _ in range(120)] + [[3 + 0.05 * i, 0, 0] for i in range(40)]
    x += [[-4 + r.gauss(0, 1e-3), -4, 0] for _ in range(40)] + [[-4, -4, 0]] * 10 + [[-4 + eps, -4, 0]] * 2 + [[99, 9, 9]]
    core, label = brute_dbscan(np.array(x, float), eps, least)
    got = {q["id"]: q for q in NB.dbscan(frame(spark, x), eps, least, leaf).collect()}
    assert [got[i]["is_core"] for i in range(len(x))] == list(core)
    assert [got[i]["label"] for i in range(len(x))] == list(label)


def test_many_centres_stay_rows(spark):
    from pyspark.ml.linalg import Vectors

    from fairplay.operators import cluster as CL

    r = random.Random(8)
    x = [[r.gauss(0, 3), r.gauss(0, 3), r.gauss(0, 3)] for _ in range(300)]
    vec = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", "features"])
    labels = spark.createDataFrame([(i, i % 90 if i < 270 else -1) for i in range(300)], "id long, label long")
    out = CL.assign_to_clusters(vec, vec, labels)
    centres = np.array([np.mean([x[i] for i in range(270) if i % 90 == c], axis=0) for c in range(90)])
    want = [int(((centres - v) ** 2).sum(axis=1).argmin()) for v in np.array(x)]
    assert [q["prediction"] for q in out.orderBy("id").collect()] == want
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000  # a literal per coordinate before
