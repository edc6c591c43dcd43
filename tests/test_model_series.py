"""The model queries over the embedding series learn from the data of each row."""

import os

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_model_query_has_one_over_the_series():
    from fieldweave.plans.catalog import ORACLES, QUERIES

    made_up = ["M1_random_forest", "M2_gradient_boosting", "M3_model_choice", "M4_compare_models", "M8_train_fold", "M9_cross_validate", "M10_learning_curve", "M12_robustness", "M13_year_transfer",
               "M13_leave_group_out", "M14_experiments", "M15_out_of_fold_thresholds", "M17_top_features", "M18_predict_grid", "T14_cluster_series", "W8_save_model"]
    assert all(f"{name}_series" in QUERIES and f"{name}_series" in ORACLES for name in made_up)


def test_forest_depends_on_the_series(spark):
    from fieldweave.operators import models as M
    from fieldweave.plans import catalog_models as C

    rows = C._filled(spark, FOLDER, C._series_rows)
    total = rows.count()
    assert rows.select("v").distinct().count() > 0.9 * total  # the made-up rows: about ten
    assert C._series_rows(spark, FOLDER).where(F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x.isNotNull())).count() > 0.9 * total
    model = M.fit(M.with_vector(rows, "v"), "random_forest", {"numTrees": 5})
    assert min(tree.depth for tree in model.stages[-1].trees) > 1
