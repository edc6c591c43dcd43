"""Models that do not wait for each other train side by side, on tables that all tasks share."""

import threading

from pyspark.sql import functions as F

from fieldweave.operators import models as M


def test_models_train_side_by_side(spark):
    meet = threading.Barrier(M.AT_ONCE, timeout=20)
    assert M.each(spark.range(1), lambda i: (meet.wait(), i)[1], range(2 * M.AT_ONCE)) == list(range(2 * M.AT_ONCE))


def test_training_rows_are_spread(spark, monkeypatch):
    seen = []

    class Caught(M.Pipeline):
        def fit(self, data):
            seen.append((data.rdd.getNumPartitions(), data.count(), self.getStages()[-1]))

    monkeypatch.setattr(M, "Pipeline", Caught)
    rows = M.with_vector(spark.range(100).coalesce(1).select((F.col("id") % 2).alias("y"), F.array(F.col("id")).alias("v")), "v")
    M.fit(rows, "random_forest")
    parts, n, forest = seen[0]
    assert parts >= M.PARTS and n == 100 and forest.getCacheNodeIds()


def test_training_rows_are_made_once(spark, monkeypatch):
    """What a model reads at every pass are settled rows, not the table's history."""
    plans = []

    class Caught(M.Pipeline):
        def fit(self, data):
            plans.append(data._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(M, "Pipeline", Caught)
    rows = M.with_vector(spark.range(100).select((F.col("id") % 2).alias("y"), F.array(F.col("id")).alias("v"), F.lit(2.0).alias("own")), "v")
    for own in (None, "own"):
        M.fit(rows, "random_forest", extra_weight=own)
        M.fit(rows, "random_forest", balanced=False, extra_weight=own)
    assert len(plans) == 4 and not any("Range" in p for p in plans)
