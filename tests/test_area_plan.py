"""Distinct rings are worked out once and without a sort of whole rings, whoever reads them afterwards."""

from pyspark.sql import functions as F

from fieldweave.operators import areas as AR


def test_input_is_read_once_and_not_sorted(spark):
    rows = [(k, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0 + k)], 1, k % 2) for k in range(4)] * 2
    box = F.struct(F.lit(0.0).alias("south"), F.lit(0.0).alias("west"), F.lit(1.0).alias("north"), F.lit(1.0).alias("east"))
    rings = spark.createDataFrame(rows, "k int, xy array<struct<x:double,y:double>>, p int, q int").withColumn("box", box)
    found = AR.exact_areas(rings, ["k"], ["p", "q"], {"a": ("any", ["p"]), "both": ("all", ["p", "q"])}, box="box")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan
    got = {r.k: (round(r.a, 6), round(r.both, 6)) for r in found.collect()}
    area = {k: 0.5 if k == 0 else 0.5 * (1 + k) - 0.5 * k * k / (1 + k) for k in range(4)}
    assert got == {k: (round(a, 6), round(a * (k % 2), 6)) for k, a in area.items()}
