"""The floors of the model queries tell a model that has learnt from one that has not."""

import os

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    from fieldweave.plans import catalog_models as C
    from fieldweave.session import settled

    return settled(C._vec(spark, FOLDER, C._series_rows))


def flags(rows, kind="random_forest", params=None):
    from fieldweave.operators import evaluation as E
    from fieldweave.operators import models as M
    from fieldweave.plans import catalog_models as C

    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    scored = M.score(M.fit(train, kind, params), test)
    one = C.above(E.metrics_at(scored, "y", "p").select(*C.SCORES_ONE), C.SCORES_ONE).first().asDict()
    two = C.judged(scored.select("y", (F.col("p") >= 0.5).cast("int").alias("guess")), []).first().asDict()
    return one, {k: two[k] for k in ("precision", "recall", "f1_score", "accuracy")}


def test_a_right_target_reaches_them(rows):
    one, two = flags(rows, params={"numTrees": 40, "maxDepth": 8})
    assert all(one.values()) and all(two.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_shuffled_target_does_not(rows, seed):
    """The same rows with the target of other rows."""
    from pyspark.sql import Window

    n = rows.count()
    place = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("#", F.lit(seed), "id"))))
    order = rows.withColumn("k", place).select("k", "y")
    mixed = rows.drop("y").withColumn("k", F.row_number().over(Window.orderBy("id")) % n + 1).join(order, "k")
    one, two = flags(mixed, params={"numTrees": 20, "maxDepth": 8})
    assert not (one["roc_auc"] and one["average_precision"] and one["precision"])
    assert not all(two.values())
