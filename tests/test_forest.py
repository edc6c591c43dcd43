"""Forests grown in tasks: the trees of a plain recursion, kept in files and not in the driver."""

import numpy as np
import pytest
from pyspark.ml.wrapper import JavaModel
from pyspark.sql import functions as F

from fieldweave.operators import forest as FO
from fieldweave.operators import models as M


def plain(bins, y, w, at, depth, most):
    """Vote of each row of ``at`` by a tree that tries every feature and cut."""
    total, pos = w[at].sum(), (w * y)[at].sum()
    best = None
    if depth < most and 0 < pos < total:
        gini = lambda m: 1 - ((w * y)[m].sum() / w[m].sum()) ** 2 - ((w * (1 - y))[m].sum() / w[m].sum()) ** 2
        for f in range(bins.shape[1]):
            for c in range(int(bins[at, f].max())):
                left, right = at[bins[at, f] <= c], at[bins[at, f] > c]
                if len(left) and len(right):
                    gain = gini(at) - w[left].sum() / total * gini(left) - w[right].sum() / total * gini(right)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = gain, left, right
    if best is None:
        return dict.fromkeys(at.tolist(), pos / total)
    return plain(bins, y, w, best[1], depth + 1, most) | plain(bins, y, w, best[2], depth + 1, most)


@pytest.mark.parametrize("most", [1, 3, 30])
def test_tree_is_that_of_a_plain_recursion(most, monkeypatch):
    monkeypatch.setattr(FO, "CELLS", 100)
    monkeypatch.setattr(FO, "COUNTED", 50)
    rng = np.random.default_rng(most)
    x = rng.normal(size=(150, 3))
    y = ((x[:, 0] > 0) ^ (rng.random(150) < 0.2)).astype(np.uint8)
    w = np.where(y == 1, 1.5, 0.8)
    bins = FO.binned(x, FO.cut_points(x, 8))
    tree = FO.grow(bins, y, w, 0, FO.Shape(1, most, 3, 8, 1, False, 1.0, 1, 0.0))
    want = plain(bins, y.astype(float), w, np.arange(150), 0, most)
    assert FO.walked(bins, *(tree[c] for c in ("feature", "bin", "child", "vote"))) == pytest.approx([want[i] for i in range(150)])


def test_cut_points():
    assert FO.cut_points(np.array([[1.0], [1.0], [3.0], [7.0]]), 8)[0].tolist() == [2.0, 5.0]
    assert len(FO.cut_points(np.random.default_rng(0).normal(size=(1000, 1)), 32)[0]) == 31
    assert FO.cut_points(np.ones((5, 1)), 32)[0].tolist() == []


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 6))
    y = ((v[:, 0] > 0) ^ (rng.random(900) < 0.05)).astype(int)
    return M.with_vector(spark.createDataFrame([(i, int(a), [float(t) for t in b], i % 3) for i, (a, b) in enumerate(zip(y, v))], "id long, y int, v array<double>, fold int"), "v")


def test_trees_are_kept_in_files(spark, rows):
    model = M.fit(rows.filter("fold <> 0"), "random_forest", {"numTrees": 12})
    forest = model.stages[-1]
    assert not isinstance(forest, JavaModel)
    kept = spark.read.parquet(forest.folder)
    assert kept.count() == len(forest.trees) == 12 and kept.agg(F.sum("nodes")).first()[0] == sum(t.numNodes for t in forest.trees)
    assert forest.featureImportances.toArray().argmax() == 0 and forest.featureImportances.toArray().sum() == pytest.approx(1)
    scored = M.score(model, rows.filter("fold = 0"))
    assert scored.count() == 300 and {"id", "y", "p"} <= set(scored.columns)
    assert scored.agg(F.avg((F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("double"))).first()[0] > 0.85


def test_the_same_forest_each_time(rows):
    told = [{r["id"]: r["p"] for r in M.score(M.fit(rows, "random_forest", {"numTrees": 7}), rows).collect()} for _ in range(2)]
    assert told[0] == told[1]


def test_few_bytes_of_trees_a_scoring_task(rows, monkeypatch):
    model = M.fit(rows, "random_forest", {"numTrees": 9, "maxDepth": 4})
    want = {r["id"]: r["p"] for r in M.score(model, rows).collect()}
    monkeypatch.setattr(FO, "TREE_BYTES", 1)
    monkeypatch.setattr(FO, "BLOCK_BYTES", 60)
    assert {r["id"]: r["p"] for r in M.score(model, rows).collect()} == want


def test_labels_of_other_kinds_are_an_error(spark):
    rows = M.with_vector(spark.range(9).select(F.col("id").alias("y"), F.array("id").alias("v")), "v")
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        M.fit(rows, "random_forest")


def test_points_of_a_learning_curve_do_not_wait(rows, monkeypatch):
    seen = []
    each = M.each
    monkeypatch.setattr(M, "each", lambda t, make, items: (seen.append(list(items)), each(t, make, seen[-1]))[1])
    got = M.learning_curve(rows.drop("x"), [0.5, 1.0], [0, 1], params={"numTrees": 3, "maxDepth": 3}).collect()
    assert len(seen[0]) == 4 and {(r["share"], r["part"]) for r in got} == {(s, p) for s in (0.5, 1.0) for p in ("train", "validation")}
