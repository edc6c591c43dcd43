"""A mask is a grid of cells a file, many more than the files Spark counts."""

from pyspark.sql import functions as F

from fieldweave.operators import raster as RA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mask_is_not_broadcast(spark):
    files = spark.range(3).select(F.col("id").cast("string").alias("file_id"))
    mask = RA.full_grid(files, 2, 2).withColumn("clear", (F.col("row") == F.col("col")).cast("int"))
    px = RA.full_grid(files, 2, 2).withColumn("b4", F.lit(7))
    out = RA.apply_usable_mask(px, mask, ["file_id"], ["b4"], (2, 2), (2, 2))
    assert "Broadcast" not in plan_of(out)
    assert out.filter("b4 = 7").count() == 6 and out.count() == 12
