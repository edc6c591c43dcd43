"""Training helpers on a small separable table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import models as M
from fieldweave.operators.balance import oversample


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    y = (rng.uniform(size=240) < 0.25).astype(int)
    v = rng.normal(size=(240, 5)) + y[:, None] * 2
    return spark.createDataFrame([(i, int(a), [float(t) for t in b], i % 3) for i, (a, b) in enumerate(zip(y, v))], "id long, y int, v array<double>, fold int")


def test_save_load_and_scores(spark, rows, tmp_path):
    data = M.with_vector(rows, "v")
    model = M.fit(data, "random_forest", {"numTrees": 5, "maxDepth": 3})
    M.save_model(model, str(tmp_path / "m"))
    a = {r["id"]: r["p"] for r in M.score(model, data).select("id", "p").collect()}
    b = {r["id"]: r["p"] for r in M.score(M.load_model(str(tmp_path / "m")), data).select("id", "p").collect()}
    assert a == b
    m = M.fold_metrics(M.score(model, data)).first()
    assert m["roc_auc"] > 0.9 and m["tp"] + m["fn"] == rows.filter("y = 1").count()


def test_unknown_model_and_parameter_filter():
    with pytest.raises(ValueError):
        M.build("oracle")
    assert M.build("decision_tree", {"numTrees": 3, "maxDepth": 2}).getMaxDepth() == 2


def test_balanced_weights(rows):
    w = M.balanced_weights(rows).groupBy("y").agg(F.sum("w").alias("s")).collect()
    assert [r["s"] for r in w] == pytest.approx([120.0, 120.0])


def test_oversample_stays_between(rows):
    out = oversample(rows, "y", "id", "v")
    n = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert n[0] == n[1]
    real = np.array([r["v"] for r in rows.filter("y = 1").collect()])
    new = np.array([r["v"] for r in out.filter("synthetic").collect()])
    assert (new >= real.min(0) - 1e-9).all() and (new <= real.max(0) + 1e-9).all()


def test_cross_validation_rows(rows):
    got = M.cross_validate(rows, [0, 1], params={"numTrees": 3, "maxDepth": 3}).collect()
    assert [r["fold"] for r in got] == [0, 1] and all(0 <= r["average_precision"] <= 1 for r in got)


def test_published_defaults_and_grid_errors(spark):
    from fieldweave.operators.raster import rebuild_mask

    assert M.build("random_forest").getMaxDepth() == 30 and M.build("random_forest").getNumTrees() == 100
    guesses = spark.createDataFrame([(1, 0, 0, 1), (1, 5, 0, 1)], "file_id int, row int, col int, guess int")
    assert rebuild_mask(guesses.filter("row = 0"), guesses, 2, 2, "guess").count() == 4
    with pytest.raises(Exception, match="outside the grid"):
        rebuild_mask(guesses, guesses, 2, 2, "guess").collect()


def test_narrow_neighbours_keep_their_digits(spark):
    from fieldweave.operators.balance import nearest_neighbours

    rng = np.random.default_rng(1)
    x = 10_000 + rng.normal(size=(60, 3)) * 0.001
    wide = np.c_[x, np.zeros((60, 300))]
    got = []
    for v in (x, wide):
        points = spark.createDataFrame([(i, [float(t) for t in row]) for i, row in enumerate(v)], "id long, v array<double>")
        got.append(sorted(tuple(r) for r in nearest_neighbours(points, "id", "v", 3).select("id", "neighbour", "rank").collect()))
    assert got[0] == got[1]
