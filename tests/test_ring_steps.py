"""What a step of the projection uses several times is computed once a vertex."""

from pyspark.sql import functions as F

from fieldweave.functions import geo as G


def test_one_conformal_latitude_a_vertex(spark):
    ring = F.array(G.point(F.lit(27.1) + F.rand(1), F.lit(-15.2) + F.rand(2)))
    df = spark.range(1).select(ring.alias("r")).select(G.ring_to_utm("r").alias("m"), "r")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ATANH(") == 3 and plan.count("ATAN2(") == 1
    row = df.select("r", "m", *[c.alias(n) for c, n in zip(G.to_utm(F.col("r")[0]["lon"], F.col("r")[0]["lat"], G.AREA_ZONE), ("x", "y"))]).first()
    assert (row["m"][0]["x"], row["m"][0]["y"]) == (row["x"], row["y"])
